"""Mail-shaped views of the given tables, as the same SQL text for both engines.

Documents become plain mails (first sentence as subject, ``toxic`` as label), web pages
become HTML mails with a payload appended so that every URL and markup rule fires.
Message ids stay unique at any scale: even for documents, odd for pages.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailscreen.session import spread

DOC_MAILS = r"""
SELECT 2 * d.doc_id AS msg_id, d.source AS dataset_source,
       regexp_extract(d.text, '^([^.!?\n]*)', 1) AS subject,
       d.text AS body, CAST(l.toxic AS INT) AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

PAGE_MAILS = r"""
SELECT 2 * page_id + 1 AS msg_id, 'pages' AS dataset_source,
       regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS subject,
       concat(html, ' ', url, '. ', CASE page_id % 9
         WHEN 1 THEN '<p>URGENT: verify your account at http://192.168.10.5/login now!</p>'
         WHEN 2 THEN '<a href="https://bit.ly/3xY?x=1&amp;y=2">click here</a>'
         WHEN 3 THEN 'Visit http://secure-paypal.tk/a?redirect=http://evil.top/b).'
         WHEN 4 THEN '<form action="https://login.example.xyz:8080/p"><input></form>'
         WHEN 5 THEN '<iframe src="https://a.example.com/f"></iframe> www.example.org/x, '
         WHEN 6 THEN 'factura pago, estimado cliente! http://t.co/abc?next_url=https://goo.gl/z'
         WHEN 7 THEN '<form action="http://10.0.0.1/p"></form><iframe src="http://10.0.0.1/f"></iframe> urgent: verify your paypal account'
         WHEN 8 THEN '<!-- http://hidden.example.ml/ --> &quot;Dear customer&quot; ftp://files.example.cf/x;'
         ELSE '' END) AS body,
       CAST(NULL AS INT) AS label
FROM pages
"""

ALL_MAILS = f"{DOC_MAILS} UNION ALL {PAGE_MAILS}"

# The seven corpora in column shapes of their own; ``msg_id`` rides along for checks.
CORPUS_SHAPES = {
    "CEAS_08": r"""
SELECT 2 * d.doc_id AS msg_id, regexp_extract(d.text, '^([^.!?\n]*)', 1) AS subject,
       d.text AS body, CAST(l.toxic AS STRING) AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""",
    "Enron": r"""
SELECT conv_id * 1000 + turn AS msg_id, role AS Subject, text AS Message,
       CASE role WHEN 'user' THEN 'ham' ELSE 'spam' END AS Spam
FROM conversations
""",
    "Ling": r"""
SELECT d.doc_id AS msg_id, d.text AS text,
       CASE l.quality WHEN 0 THEN 'Spam' ELSE ' legit' END AS spamclass
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""",
    "Nazario": "SELECT item_id AS msg_id, text AS body FROM benchmark",
    "Nigerian_Fraud": "SELECT page_id AS msg_id, url AS subject, html AS message FROM pages",
    "phishing_email": r"""
SELECT d.doc_id AS msg_id, d.text AS text_combined,
       CASE l.toxic WHEN 1 THEN '1.0' ELSE '0.0' END AS label
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""",
    "SpamAssasin": r"""
SELECT d.doc_id AS msg_id, d.source AS subject, d.text AS text,
       CASE l.toxic WHEN 1 THEN 'TRUE ' WHEN 0 THEN ' No' END AS v1
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
}
ENRON_BAD = r"""
SELECT conv_id * 1000 + turn AS msg_id, role AS Subject, text AS Message,
       CASE role WHEN 'user' THEN 'ham' WHEN 'assistant' THEN 'spam' ELSE 'unsure' END AS Spam
FROM conversations
"""

RAW_LABELS = r"""
SELECT doc_id, CASE doc_id % 11
         WHEN 0 THEN ' Spam ' WHEN 1 THEN 'HAM' WHEN 2 THEN '1.0' WHEN 3 THEN '0'
         WHEN 4 THEN 'Yes' WHEN 5 THEN 'benign' WHEN 6 THEN 'maybe' WHEN 7 THEN NULL
         WHEN 8 THEN 'TRUE' WHEN 9 THEN concat(chr(160), 'phishing', chr(9))
         ELSE source END AS raw
FROM documents
"""

BLANKED = f"""
SELECT msg_id,
       CASE WHEN msg_id % 5 = 0 THEN concat(' ', chr(160), chr(9))
            WHEN msg_id % 5 = 1 THEN NULL ELSE subject END AS subject,
       CASE WHEN msg_id % 10 IN (0, 2) THEN concat(chr(10), chr(28), ' ')
            WHEN msg_id % 10 = 6 THEN NULL ELSE body END AS body
FROM ({ALL_MAILS}) m
"""

NOISY = (
    "concat(' ', subject, chr(9), ' ', chr(7), '  ', chr(10), ' ', chr(10), chr(10), chr(10), "
    "chr(10), chr(160), chr(133), chr(127), chr(28), body, chr(11))"
)
REPLY_PREFIX = (
    "CASE msg_id % 4 WHEN 0 THEN 'RE : ' WHEN 1 THEN ' fwd:' WHEN 2 THEN 'Reg: ' ELSE '' END"
)

STREAM_EPOCH = 1_704_067_200  # 2024-01-01 00:00:00 UTC
# event times in steps of two hours and more, so that even small tables fill many windows
STREAM_STEP, STREAM_SPAN = 7_919, 30 * 86_400

# labels are sent to every task up to so many rows, some 50 MB, so that texts stay where they
# were read; more are joined by shuffle
BROADCAST_LABELS = 2_000_000

TABLES = ("documents", "labels", "pages", "conversations", "benchmark")


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    def load(name: str) -> DataFrame:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "labels":
            return F.broadcast(table) if table.count() <= BROADCAST_LABELS else table
        return spread(table)

    tables = {
        name: load(name)
        for name in TABLES
        if re.search(rf"\b(?:FROM|JOIN) {name}\b", sql)
    }
    # frames are passed by name, so no temp view outlives the call; a raw-string
    # literal keeps the newline escape for the regex engine in both dialects
    sql = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", sql)
    return spark.sql(sql.replace(r"\n]", r"\\n]"), **tables)


def doc_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, DOC_MAILS)


def page_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, PAGE_MAILS)


def all_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, ALL_MAILS)


def mail_splits(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of the scans that all mails are made from."""
    scans = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "pages"))
    return sum(scan.rdd.getNumPartitions() for scan in scans)


def corpus_frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _run(spark, sf_dir, ENRON_BAD if name == "Enron_bad" else CORPUS_SHAPES[name])


def raw_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, RAW_LABELS)


def blanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, BLANKED)


def with_event_time(mails: DataFrame) -> DataFrame:
    """Mails with an event time within 30 days."""
    seconds = F.lit(STREAM_EPOCH) + (F.col("msg_id") * STREAM_STEP) % STREAM_SPAN
    return mails.select("msg_id", "subject", "body", F.timestamp_seconds(seconds).alias("event_ts"))


def stream_mails(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Streams of documents and pages as one stream of mails."""
    plain = documents.select(
        (2 * F.col("doc_id")).alias("msg_id"),
        F.regexp_extract("text", r"^([^.!?\n]*)", 1).alias("subject"),
        F.col("text").alias("body"),
    )
    sql = PAGE_MAILS.replace("FROM pages", "FROM {pages}")
    marked_up = documents.sparkSession.sql(sql, pages=pages).select("msg_id", "subject", "body")
    return with_event_time(plain.union(marked_up))
