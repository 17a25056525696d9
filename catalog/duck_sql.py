"""The same queries as plain SQL for DuckDB, over the same tables."""

from __future__ import annotations

from catalog import mail_tables as mt
from catalog.spark_queries import SWEEP_GRID
from mailscreen import lexicons as lx
from mailscreen.operators.corpus import SOURCES
from mailscreen.params import RequestLimits, ScreenParams, SplitParams

P = ScreenParams()
L = RequestLimits()
SPLIT = SplitParams()

WS_CHARS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS, NON_WS = f"[{WS_CHARS}]", f"[^{WS_CHARS}]"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


URL_CHARS = rf"""[^{WS_CHARS}<>"'(){{}}\[\]]+"""
URL = quoted(rf"(?i)(?:https?|ftp)://{URL_CHARS}|\bwww\.{URL_CHARS}")
URL_TAIL = quoted(r"[.,;:!?)>»\]]+$")
HOST = quoted(rf"(?i)^(?:https?|ftp)://([^/:?#{WS_CHARS}]+)")


def unescape(x: str) -> str:
    """The references occurring in the data; '&amp;' last, so that one pass is one pass.

    All of these names are also valid without their semicolon.
    """
    for entity, char in (("quot", '"'), ("lt", "<"), ("gt", ">"), ("copy", "©"), ("middot", "·"),
                         ("nbsp", "\xa0"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{entity};?', '{char}', 'g')"
    return x


def sub(x: str, pattern: str, to: str = "' '") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {to}, 'g')"


def style_script(x: str) -> str:
    return sub(x, r"(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>")


def comments(x: str) -> str:
    return sub(x, r"(?s)<!--.*?-->")


def tags(x: str) -> str:
    return sub(x, r"</?[a-zA-Z][^>]*>")


def collapse(x: str) -> str:
    return f"trim({sub(x, WS + '+')})"


def strip_decoded(x: str) -> str:
    return collapse(unescape(tags(comments(style_script(x)))))


def control(x: str) -> str:
    return sub(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "''")


def fold(x: str) -> str:
    return sub(f"strip_accents({x})", r"[^\x00-\x7F]", "''")


def tidy(x: str) -> str:
    return collapse(fold(control(x)))


def strip_ws(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "''")


def find_urls(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({x}, {URL}), "
        f"lambda v: regexp_replace(v, {URL_TAIL}, '')), lambda v: v <> '')"
    )


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def count_terms(x: str, terms) -> str:
    return f"CAST(len(list_filter({array(terms)}, lambda w: contains(lower({x}), w))) AS INTEGER)"


def entropy(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0.0 ELSE round(abs(list_entropy(string_split({x}, ''))), 4) END"


def words(x: str) -> str:
    return f"CAST(CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END AS INTEGER)"


def matches(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {quoted(pattern)})) AS INTEGER)"


def upper_ratio(x: str) -> str:
    return (
        f"coalesce(round({matches(x, '[A-Z]')}::DOUBLE / "
        f"nullif({matches(x, '[A-Za-z]')}, 0), 4), 0.0)"
    )


# ---------------------------------------------------------------- shared steps

MAILS = f"mails AS MATERIALIZED ({mt.ALL_MAILS})"
DOCS = f"mails AS MATERIALIZED ({mt.DOC_MAILS})"

CLEAN = f"""
decoded AS MATERIALIZED (
  SELECT msg_id, label, body AS raw, {unescape("body")} AS decoded,
         {tidy("subject")} AS subject_clean
  FROM mails),
stripped AS MATERIALIZED (
  SELECT *, {strip_decoded("decoded")} AS stripped FROM decoded),
outer_urls AS MATERIALIZED (
  SELECT *, {tidy("stripped")} AS body_clean,
         list_concat({find_urls("decoded")}, {find_urls("stripped")}) AS found
  FROM stripped),
with_nested AS MATERIALIZED (
  SELECT * EXCLUDE (found), {ordered_distinct("found")} AS outer_list,
         flatten(list_transform(
           list_filter({ordered_distinct("found")}, lambda u: contains(u, '?')),
           lambda u: {find_urls("substr(u, strpos(u, '?'))")})) AS nested
  FROM outer_urls),
joined AS MATERIALIZED (
  SELECT *, list_concat(outer_list, nested) AS all_urls FROM with_nested),
listed AS MATERIALIZED (
  SELECT * EXCLUDE (all_urls), {ordered_distinct("all_urls")} AS urls FROM joined),
hosts AS MATERIALIZED (
  SELECT *, list_filter(list_transform(urls, lambda u: lower(regexp_extract(u, {HOST}, 1))),
                        lambda h: h <> '') AS host_list
  FROM listed),
clean AS MATERIALIZED (
  SELECT *, {ordered_distinct("host_list")} AS domains,
         subject_clean || ' ' || body_clean AS both_texts
  FROM hosts)"""

IP = r"(?i)^https?://[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?:[:/]|$)"
REDIRECT = r"(?i)[?&](?:redirect|url|next|goto|return|redir|continue|target)(?:_url|_to)?="
TLD = r"\.(?:" + "|".join(lx.RISKY_TLDS) + ")$"
SPECIAL = rf"[^A-Za-z0-9{WS_CHARS}]"


def any_match(items: str, pattern: str) -> str:
    return f"len(list_filter({items}, lambda u: regexp_matches(u, {quoted(pattern)}))) > 0"


def n_match(items: str, pattern: str) -> str:
    return (
        f"CAST(len(list_filter({items}, lambda u: regexp_matches(u, {quoted(pattern)}))) "
        "AS INTEGER)"
    )


FEATURE_SQL = {
    "subject_length": "CAST(length(subject_clean) AS INTEGER)",
    "body_length": "CAST(length(body_clean) AS INTEGER)",
    "body_word_count": words("body_clean"),
    "body_digit_count": matches("body_clean", "[0-9]"),
    "body_special_char_count": matches("body_clean", SPECIAL),
    "body_entropy": entropy("body_clean"),
    "ratio_uppercase_body": upper_ratio("body_clean"),
    "ratio_uppercase_subject": upper_ratio("subject_clean"),
    "exclamation_count": f"{matches('body_clean', '!')} + {matches('subject_clean', '!')}",
    "num_urls": "CAST(len(urls) AS INTEGER)",
    "num_unique_domains": "CAST(len(domains) AS INTEGER)",
    "has_url": "len(urls) > 0",
    "has_ip_url": any_match("urls", IP),
    "has_url_shortener": f"list_has_any(domains, {array(lx.SHORTENER_HOSTS)})",
    "num_suspicious_tlds": n_match("domains", TLD),
    "max_url_entropy": "coalesce(list_max(list_transform(urls, lambda u: "
                       "round(abs(list_entropy(string_split(u, ''))), 4))), 0.0)",
    "avg_url_length": "CASE WHEN len(urls) > 0 THEN round(list_sum(list_transform(urls, "
                      "lambda u: length(u)))::DOUBLE / len(urls), 2) ELSE 0.0 END",
    "num_redirect_params": n_match("urls", REDIRECT),
    "max_url_length": "CAST(coalesce(list_max(list_transform(urls, lambda u: length(u))), 0) "
                      "AS INTEGER)",
    "has_html": f"regexp_matches(raw, {quoted('<[a-zA-Z][^>]*>')})",
    "has_form": rf"regexp_matches(raw, '(?i)<form\b')",
    "has_iframe": rf"regexp_matches(raw, '(?i)<iframe\b')",
    "has_urgency_words": f"{count_terms('both_texts', lx.URGENCY_TERMS)} > 0",
    "urgency_word_count": count_terms("both_texts", lx.URGENCY_TERMS),
    "brand_mention_count": count_terms("both_texts", lx.BRAND_TERMS),
    "has_brand_mention": f"{count_terms('both_texts', lx.BRAND_TERMS)} > 0",
    "subject_is_empty": "subject_clean = ''",
    "subject_has_re_fwd": rf"regexp_matches(subject_clean, '(?i)^\s*(re|fw|fwd)\s*:')",
    "subject_entropy": entropy("subject_clean"),
    "subject_exclamations": matches("subject_clean", "!"),
    "subject_has_urgency": f"{count_terms('subject_clean', lx.URGENCY_TERMS)} > 0",
    "subject_has_brand": f"{count_terms('subject_clean', lx.BRAND_TERMS)} > 0",
}
FEATURES = (
    "features AS MATERIALIZED (SELECT msg_id, label, subject_clean, body_clean, "
    + ", ".join(f"{sql} AS {name}" for name, sql in FEATURE_SQL.items())
    + " FROM clean)"
)

PREPARED_TEXT = (
    f"CASE WHEN subject_clean <> '' THEN subject_clean || {quoted(lx.TEXT_SEPARATOR)} "
    "|| body_clean ELSE body_clean END"
)


def dbl(value: float) -> str:
    return f"{value!r}::DOUBLE"


def signal(name: str) -> str:
    kind = lx.FEATURE_TYPES[name]
    if kind == "boolean":
        return f"CAST({name} AS INTEGER)::DOUBLE"
    if name.startswith("ratio_"):
        return f"CASE WHEN {name} > 0.5 THEN 1.0::DOUBLE ELSE {name} END"
    return (
        f"CASE WHEN {name} > 1 THEN least({name}::DOUBLE, 3.0::DOUBLE) / 3.0::DOUBLE "
        f"ELSE {name}::DOUBLE END"
    )


TERMS = {n: f"{dbl(w)} * ({signal(n)})" for n, w in lx.HEURISTIC_WEIGHTS.items()}
META_SCORE = f"least(greatest({' + '.join(f'({t})' for t in TERMS.values())}, 0.0), 1.0)"


def text_score(p: str) -> str:
    urgency = count_terms(p, lx.URGENCY_TERMS)
    n_words = f"greatest({words(f'trim({p})')}, 1)"
    return (
        f"CASE WHEN trim({p}) = '' THEN 0.0::DOUBLE ELSE least(least(({urgency}::DOUBLE / {n_words}) "
        f"/ {dbl(lx.URGENCY_DENSITY_FULL)}, 1.0::DOUBLE) * {dbl(lx.URGENCY_DENSITY_WEIGHT)} "
        f"+ least({urgency}::DOUBLE / {dbl(lx.URGENCY_COUNT_SCALE)}, {dbl(lx.URGENCY_COUNT_CAP)}), "
        "1.0::DOUBLE) END"
    )


def fused(alpha: float) -> str:
    return (
        f"least(greatest({dbl(alpha)} * score_meta + {dbl(1.0 - alpha)} * score_text, 0.0), 1.0)"
    )


STAGES = f"""
meta AS MATERIALIZED (SELECT *, {META_SCORE} AS score_meta FROM features),
gated AS MATERIALIZED (
  SELECT *, score_meta >= {dbl(P.gate_threshold)} AS gated,
         CASE WHEN score_meta >= {dbl(P.gate_threshold)} THEN '' ELSE {PREPARED_TEXT} END
           AS prepared_text
  FROM meta),
texted AS MATERIALIZED (
  SELECT *, CASE WHEN gated THEN NULL ELSE {text_score("prepared_text")} END AS score_text
  FROM gated),
stages AS MATERIALIZED (
  SELECT *, CASE WHEN gated THEN score_meta ELSE {fused(P.alpha)} END AS score_final
  FROM texted)"""


def over_mails(result: str, columns: str = "") -> str:
    return f"WITH {MAILS} SELECT msg_id, {result} AS result {columns} FROM mails"


def over_clean(result: str) -> str:
    return f"WITH {MAILS}, {CLEAN} SELECT msg_id, {result} AS result FROM clean"


def over_stages(columns: str, source: str = MAILS) -> str:
    return f"WITH {source}, {CLEAN}, {FEATURES}, {STAGES} SELECT {columns} FROM stages"


LABEL = f"CASE WHEN score_final >= {dbl(P.decision_threshold)} THEN 'phishing' ELSE 'legitimate' END"
FLAT = (
    f"msg_id, {LABEL} AS label_predicted, "
    f"score_final >= {dbl(P.decision_threshold)} AS is_phishing, "
    "round(score_final, 6) AS score_final, round(score_meta, 6) AS score_meta, "
    "round(score_text, 6) AS score_text, gated, "
    f"{dbl(P.gate_threshold)} AS threshold, prepared_text, "
    "'heuristic_meta_v1' AS meta_model_name, "
    "CASE WHEN NOT gated THEN 'heuristic_text_v1' END AS text_model_name, "
    + ", ".join(lx.FEATURES)
)

# ---------------------------------------------------------------- corpora


def label_of(raw: str) -> str:
    key = f"lower({strip_ws(raw)})"
    return (
        f"CAST(CASE WHEN {key} IN ({', '.join(map(quoted, lx.PHISHING_LABELS))}) THEN 1 "
        f"WHEN {key} IN ({', '.join(map(quoted, lx.LEGITIMATE_LABELS))}) THEN 0 END AS INTEGER)"
    )


def mapped(name: str, shape: str | None = None) -> str:
    subject, body, label, imputed = {
        "CEAS_08": ("subject", "body", label_of("coalesce(label, '0')"), "label IS NULL"),
        "Enron": ("Subject", "Message", label_of("coalesce(Spam, '0')"), "Spam IS NULL"),
        "Ling": ("''", "text", label_of("coalesce(spamclass, '0')"), "spamclass IS NULL"),
        "Nazario": ("''", "body", "CAST(1 AS INTEGER)", "false"),
        "Nigerian_Fraud": ("subject", "message", "CAST(1 AS INTEGER)", "false"),
        "phishing_email": ("''", "text_combined", label_of("coalesce(label, '0')"),
                           "label IS NULL"),
        "SpamAssasin": ("subject", "text", label_of("coalesce(v1, '0')"), "v1 IS NULL"),
    }[name]
    return (
        f"SELECT msg_id, '{name}' AS dataset_source, coalesce({subject}, '') AS subject, "
        f"coalesce({body}, '') AS body, {label} AS label, {imputed} AS label_imputed "
        f"FROM ({shape or mt.CORPUS_SHAPES[name]}) r"
    )


NOT_BLANK = (
    f"(regexp_matches(coalesce(subject, ''), {quoted(NON_WS)}) "
    f"OR regexp_matches(coalesce(body, ''), {quoted(NON_WS)}))"
)
HASH = "md5(coalesce(subject, '') || chr(0) || coalesce(body, ''))"
ALL_SOURCES = " UNION ALL ".join(mapped(n) for n in mt.CORPUS_SHAPES)
UNIFIED = f"""
unified AS MATERIALIZED (
  SELECT msg_id, dataset_source, subject, body, label, {HASH} AS content_hash
  FROM ({ALL_SOURCES}) u WHERE {NOT_BLANK})"""
PRIORITY = "CASE dataset_source " + " ".join(
    f"WHEN '{s.name}' THEN {i}" for i, s in enumerate(SOURCES)
) + f" ELSE {len(SOURCES)} END"
UNIQUE = f"""{UNIFIED},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY {PRIORITY}, msg_id) AS rn
  FROM unified),
uniq AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1)"""
BUCKET = (
    f"(('0x' || substr(md5(content_hash || '{SPLIT.seed}'), 1, 8))::BIGINT % {SPLIT.buckets})"
)
SPLIT_CASE = (
    f"CASE WHEN {BUCKET} < {SPLIT.train_end} THEN 'train' "
    f"WHEN {BUCKET} < {SPLIT.val_end} THEN 'val' ELSE 'test' END"
)

# ---------------------------------------------------------------- metrics

SCORED = f"""{DOCS.replace("mails AS", "docs AS")},
mails AS MATERIALIZED (SELECT * FROM docs WHERE label IS NOT NULL), {CLEAN}, {FEATURES}, {STAGES},
scored AS MATERIALIZED (
  SELECT msg_id, label, score_final AS score, CAST(score_final >= 0.5 AS INTEGER) AS prediction
  FROM stages)"""
CONFUSION = """
conf AS (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp,
                count(*) FILTER (label = 0 AND prediction = 1) AS fp,
                count(*) FILTER (label = 1 AND prediction = 0) AS fn,
                count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM scored),
pr AS (SELECT coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision,
              coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall FROM conf),
prf AS (SELECT precision, recall,
               coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1
        FROM pr)"""

# ---------------------------------------------------------------- text corpus

PREPARED = f"""{MAILS}, {CLEAN},
prepared AS MATERIALIZED (SELECT msg_id, label, {PREPARED_TEXT} AS prepared_text FROM clean),
tokens AS MATERIALIZED (
  SELECT msg_id, regexp_extract_all(lower(prepared_text), '[a-z0-9_]{{2,}}') AS t FROM prepared),
grams AS MATERIALIZED (
  SELECT msg_id, list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))
         AS g FROM tokens)"""
TF = """
tf AS MATERIALIZED (
  SELECT msg_id, term, CAST(count(*) AS INTEGER) AS tf
  FROM (SELECT msg_id, unnest(g) AS term FROM grams) GROUP BY msg_id, term),
df AS MATERIALIZED (
  SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total FROM tf GROUP BY term),
vocab AS MATERIALIZED (
  SELECT * FROM df WHERE df >= 2 ORDER BY total DESC, term ASC LIMIT 10000)"""


def sweep() -> str:
    rows = []
    for p in SWEEP_GRID:
        final = (
            f"CASE WHEN score_meta >= {dbl(p.gate_threshold)} THEN score_meta "
            f"ELSE {fused(p.alpha)} END >= {dbl(p.decision_threshold)}"
        )
        rows.append(
            f"SELECT {dbl(p.gate_threshold)} AS gate_threshold, {dbl(p.alpha)} AS alpha, "
            f"{dbl(p.decision_threshold)} AS decision_threshold, "
            f"count(*) FILTER (score_meta >= {dbl(p.gate_threshold)}) AS n_gated, "
            f"count(*) FILTER ({final}) AS n_phishing, "
            f"count(*) FILTER ({final} AND label = 1) AS true_positives, "
            f"count(*) FILTER ({final} AND label = 0) AS false_positives FROM ungated"
        )
    return (
        f"WITH {MAILS}, {CLEAN}, {FEATURES}, ungated AS MATERIALIZED ("
        f"SELECT msg_id, label, {META_SCORE} AS score_meta, {text_score(PREPARED_TEXT)} AS score_text "
        f"FROM features) " + " UNION ALL ".join(rows)
    )


def contributions() -> str:
    terms = ", ".join(
        f"{{'pos': {i}, 'feature': '{n}', 'value': {t}}}" for i, (n, t) in enumerate(TERMS.items())
    )
    return (
        f"WITH {MAILS}, {CLEAN}, {FEATURES}, items AS (SELECT msg_id, unnest([{terms}]) AS i "
        "FROM features), ranked AS (SELECT msg_id, i.feature AS feature, i.value AS value, "
        "CAST(row_number() OVER (PARTITION BY msg_id ORDER BY i.value DESC, i.pos) AS INTEGER) "
        f"AS rank FROM items WHERE i.value > 0) SELECT msg_id, rank, feature, "
        f"round(value, 6) AS value FROM ranked WHERE rank <= {P.top_k}"
    )


STREAM_MAILS = f"""
mails AS MATERIALIZED (
  SELECT msg_id, subject, body, CAST(NULL AS INTEGER) AS label,
         {mt.STREAM_EPOCH} + (msg_id * {mt.STREAM_STEP}) % {mt.STREAM_SPAN} AS ts
  FROM ({mt.ALL_MAILS}) m)"""

SQL = {
    "src_csv": mt.CORPUS_SHAPES["CEAS_08"],
    "src_csv_rejects": f"SELECT msg_id, CAST(5 AS INTEGER) AS n_cells, 'one cell too many' AS "
                       f"surplus FROM ({mt.CORPUS_SHAPES['CEAS_08']}) r WHERE msg_id % 10 = 0",
    "src_registry": f"WITH {UNIFIED} SELECT dataset_source, count(*) AS n_rows FROM unified "
                    "WHERE dataset_source IN ('CEAS_08', 'Nazario') GROUP BY 1",
    "src_parquet_split": f"WITH {DOCS} SELECT msg_id, subject, body, label FROM mails "
                         "WHERE label IS NOT NULL",
    "sink_parquet": f"WITH {UNIFIED} SELECT msg_id, dataset_source, content_hash, label FROM unified",
    "src_request": f"""WITH {MAILS} SELECT msg_id,
        CASE WHEN body IS NULL THEN 'body missing'
             WHEN length(body) > {L.body} THEN 'body too long'
             WHEN NOT regexp_matches(body, {quoted(NON_WS)}) THEN 'body blank'
             WHEN length(subject) > {L.subject} THEN 'subject too long'
             WHEN length(dataset_source) > {L.sender} THEN 'sender too long' END AS reject_reason
        FROM mails""",
    "sink_scores": over_stages(
        f"msg_id, {LABEL} AS label, score_final >= {dbl(P.decision_threshold)} AS is_phishing, "
        "round(score_final, 6) AS score_final, round(score_meta, 6) AS score_meta, "
        f"round(score_text, 6) AS score_text, gated, {dbl(P.gate_threshold)} AS threshold, "
        "num_urls, true AS has_warning"),
    "pick_column": f"SELECT msg_id, Message AS body, 'none' AS absent "
                   f"FROM ({mt.CORPUS_SHAPES['Enron']}) r",
    "unify_schema": f"SELECT msg_id, 'any' AS dataset_source, subject, body, "
                    f"CAST(0 AS INTEGER) AS label, true AS label_imputed "
                    f"FROM ({mt.CORPUS_SHAPES['CEAS_08']}) r",
    "unify_ceas08": mapped("CEAS_08"),
    "unify_enron": mapped("Enron"),
    "unify_ling": mapped("Ling"),
    "unify_nazario": mapped("Nazario"),
    "unify_nigerian": mapped("Nigerian_Fraud"),
    "unify_phishing_email": mapped("phishing_email"),
    "unify_spamassassin": mapped("SpamAssasin"),
    "label_coerce": f"SELECT doc_id, raw, coalesce({label_of('raw')}, -1) AS label FROM ({mt.RAW_LABELS}) r",
    "drop_bad_sources": f"""WITH both_sources AS MATERIALIZED (
        {mapped("CEAS_08")} UNION ALL {mapped("Enron", mt.ENRON_BAD)})
        SELECT msg_id, dataset_source, label FROM both_sources WHERE dataset_source NOT IN (
        SELECT dataset_source FROM both_sources WHERE label IS NULL)""",
    "schema_check": f"WITH {UNIFIED} SELECT dataset_source, label, count(*) AS n_rows "
                    "FROM unified GROUP BY 1, 2",
    "filter_empty": f"SELECT msg_id, subject, body FROM ({mt.BLANKED}) b WHERE {NOT_BLANK}",
    "content_hash": f"SELECT msg_id, {HASH} AS content_hash FROM ({mt.BLANKED}) b",
    "union_all": f"SELECT msg_id, dataset_source, label FROM ({ALL_SOURCES}) u",
    "order_cast_columns": f"SELECT msg_id, dataset_source, subject, body, label, {HASH} AS "
                          f"content_hash FROM ({mapped('CEAS_08')}) u",
    "dedup_by_hash": f"WITH {UNIQUE} SELECT msg_id, dataset_source, label, content_hash FROM uniq",
    "stratified_split": f"WITH {UNIQUE} SELECT content_hash, label, {SPLIT_CASE} AS split FROM uniq",
    "stratified_split_exact": f"""WITH {UNIQUE}, placed AS (
        SELECT content_hash, label, row_number() OVER (PARTITION BY label
               ORDER BY {BUCKET}, content_hash) - 1 AS r,
               count(*) OVER (PARTITION BY label) AS n FROM uniq)
        SELECT content_hash, label,
               CASE WHEN r < floor(n * {dbl(SPLIT.train)}) THEN 'train'
                    WHEN r < floor(n * {dbl(SPLIT.train + SPLIT.val)}) THEN 'val'
                    ELSE 'test' END AS split FROM placed""",
    "html_unescape": over_mails(unescape("body")),
    "strip_style_script": over_mails(style_script("body")),
    "strip_comments": over_mails(comments("body")),
    "strip_tags": over_mails(tags("body")),
    "strip_html": over_mails(strip_decoded(unescape("body"))),
    "ascii_fold": over_mails(fold("body")),
    "strip_control": over_mails(control(mt.NOISY)),
    "collapse_ws": over_mails(collapse(mt.NOISY)),
    "collapse_ws_lines": over_mails(strip_ws(sub(
        f"array_to_string(list_transform(string_split({mt.NOISY}, chr(10)), "
        f"lambda s: {strip_ws(sub('s', '[ ' + chr(92) + 't]+'))}), chr(10))",
        r"\n{3,}", "chr(10) || chr(10)"))),
    "clean_body": over_mails(tidy(strip_decoded(unescape("body")))),
    "clean_subject": over_mails(tidy("subject")),
    "prepare_text": f"WITH {MAILS}, {CLEAN} SELECT msg_id, {PREPARED_TEXT} AS prepared_text FROM clean",
    "has_urgency": over_clean(FEATURE_SQL["has_urgency_words"]),
    "count_urgency": over_clean(FEATURE_SQL["urgency_word_count"]),
    "count_brands": over_clean(FEATURE_SQL["brand_mention_count"]),
    "shannon_entropy": over_clean(FEATURE_SQL["body_entropy"]),
    "count_digits": over_clean(FEATURE_SQL["body_digit_count"]),
    "count_special": over_clean(FEATURE_SQL["body_special_char_count"]),
    "ratio_uppercase": over_clean(FEATURE_SQL["ratio_uppercase_body"]),
    "count_exclaim": over_clean(matches("body_clean", "!")),
    "has_html": over_mails(FEATURE_SQL["has_html"].replace("raw", "body")),
    "has_form": over_mails(FEATURE_SQL["has_form"].replace("raw", "body")),
    "has_iframe": over_mails(FEATURE_SQL["has_iframe"].replace("raw", "body")),
    "is_reply_forward": over_clean(
        rf"regexp_matches(concat({mt.REPLY_PREFIX}, subject_clean), '(?i)^\s*(re|fw|fwd)\s*:')"),
    "text_token_pattern": over_clean(
        "array_to_string(regexp_extract_all(lower(body_clean), '[a-z0-9_]{2,}'), ' ')"),
    "text_tokens_accented": f"""WITH {DOCS} SELECT msg_id, array_to_string(
        regexp_extract_all(strip_accents(lower(coalesce(body, ''))), '[\\p{{L}}\\p{{N}}_]{{2,}}'), ' ')
        AS result FROM mails""",
    "extract_urls": over_clean("array_to_string(urls, ' ')"),
    "clean_url": f"""WITH {MAILS}, found AS (
        SELECT msg_id, regexp_extract_all(body, {URL}) AS l FROM mails),
        one AS (SELECT msg_id, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM found)
        SELECT msg_id, CAST(pos AS INTEGER) AS pos, raw,
               regexp_replace(raw, {URL_TAIL}, '') AS url FROM one""",
    "nested_urls": f"WITH {MAILS}, {CLEAN} SELECT msg_id, unnest(nested) AS url FROM clean",
    "extract_domains": over_clean("array_to_string(domains, ' ')"),
    "has_ip_url": over_clean(FEATURE_SQL["has_ip_url"]),
    "has_shortener": over_clean(FEATURE_SQL["has_url_shortener"]),
    "count_susp_tlds": over_clean(FEATURE_SQL["num_suspicious_tlds"]),
    "max_url_entropy": over_clean(FEATURE_SQL["max_url_entropy"]),
    "avg_url_length": over_clean(FEATURE_SQL["avg_url_length"]),
    "max_url_length": over_clean(FEATURE_SQL["max_url_length"]),
    "count_redirects": over_clean(FEATURE_SQL["num_redirect_params"]),
    "url_explode": f"""WITH {MAILS}, {CLEAN},
        one AS (SELECT msg_id, unnest(urls) AS url FROM clean)
        SELECT nullif(lower(regexp_extract(url, {HOST}, 1)), '') AS domain, count(*) AS n_urls,
               count(DISTINCT msg_id) AS n_mails, CAST(max(length(url)) AS INTEGER) AS max_length,
               count(*) FILTER (regexp_matches(url, {quoted(REDIRECT)})) AS n_redirects
        FROM one GROUP BY 1""",
    "meta_features": f"WITH {MAILS}, {CLEAN}, {FEATURES} SELECT msg_id, "
                     f"{', '.join(lx.FEATURES)} FROM features",
    "feature_vector": f"WITH {MAILS}, {CLEAN}, {FEATURES} SELECT msg_id, "
                      f"CAST({len(lx.FEATURES)} AS INTEGER) AS width, round("
                      + " + ".join(f"CAST({n} AS DOUBLE)" if lx.FEATURE_TYPES[n] != "boolean"
                                   else f"CAST(CAST({n} AS INTEGER) AS DOUBLE)"
                                   for n in lx.FEATURES)
                      + f", 3) AS total, CAST({lx.FEATURES[5]} AS DOUBLE) AS v5, "
                      f"CAST(CAST({lx.FEATURES[31]} AS INTEGER) AS DOUBLE) AS v31 FROM features",
    "extract_quality": f"""WITH {MAILS}, {CLEAN} SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS
        n_failed, count(*) FILTER (trim({PREPARED_TEXT}) = '') AS n_empty,
        round(avg(length({PREPARED_TEXT})), 4) AS mean_length FROM clean""",
    "score_meta_heuristic": over_stages("msg_id, round(score_meta, 6) AS score_meta"),
    "score_text_heuristic": f"WITH {MAILS}, {CLEAN}, p AS MATERIALIZED (SELECT msg_id, "
                            f"{PREPARED_TEXT} AS t FROM clean) SELECT msg_id, "
                            f"round({text_score('t')}, 6) AS score_text FROM p",
    "gate": over_stages("msg_id, gated"),
    "fuse": over_stages("msg_id, round(score_final, 6) AS score_final"),
    "label_decision": over_stages(f"msg_id, {LABEL} AS label_predicted"),
    "classify": over_stages(FLAT),
    "threshold_sweep": sweep(),
    "custom_scorer": f"""WITH {MAILS}, {CLEAN}, {FEATURES}, {STAGES}, custom AS (
        SELECT * EXCLUDE (score_text), CASE WHEN NOT gated THEN least(
          {count_terms("prepared_text", lx.URGENCY_TERMS)} / 8.0::DOUBLE, 1.0::DOUBLE) END
          AS score_text FROM stages)
        SELECT msg_id, CASE WHEN (CASE WHEN gated THEN score_meta ELSE {fused(P.alpha)} END)
               >= {dbl(P.decision_threshold)} THEN 'phishing' ELSE 'legitimate' END AS label_predicted,
               round(score_text, 6) AS score_text,
               CASE WHEN NOT gated THEN 'urgency_rate' END AS text_model_name FROM custom""",
    "contrib_heuristic": contributions(),
    "summary_total": f"""WITH {UNIFIED} SELECT count(*) AS n_rows,
        count(*) FILTER (label = 1) AS n_phishing, count(*) FILTER (label = 0) AS n_legitimate,
        round(count(*) FILTER (label = 1) * 100.0::DOUBLE / count(*), 4) AS pct_phishing,
        round(count(*) FILTER (label = 0) * 100.0::DOUBLE / count(*), 4) AS pct_legitimate,
        count(DISTINCT content_hash) AS n_hashes,
        count(*) - count(DISTINCT content_hash) AS n_duplicates FROM unified""",
    "summary_by_source": f"""WITH {UNIFIED} SELECT dataset_source, count(*) AS n_rows,
        count(*) FILTER (label = 1) AS n_phishing, count(*) FILTER (label = 0) AS n_legitimate
        FROM unified GROUP BY ROLLUP (dataset_source)""",
    "class_balance": f"""WITH {UNIQUE}, s AS (SELECT label, {SPLIT_CASE} AS split FROM uniq),
        n AS (SELECT split, label, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT split, label, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY split), 4) AS pct
        FROM n""",
    "class_weights": f"""WITH {DOCS}, n AS (SELECT label, count(*) AS n FROM mails
        WHERE label IS NOT NULL GROUP BY 1) SELECT label, n,
        round(sum(n) OVER ()::DOUBLE / (count(*) OVER () * n), 6) AS weight FROM n""",
    "confusion": f"WITH {SCORED}, {CONFUSION} SELECT tp, fp, fn, tn FROM conf",
    "eval_binary": f"WITH {SCORED}, {CONFUSION} SELECT round(precision, 6) AS precision, "
                   "round(recall, 6) AS recall, round(f1, 6) AS f1 FROM prf",
    "recall_gate": f"WITH {SCORED}, {CONFUSION} SELECT round(recall, 6) AS recall, "
                   f"{dbl(lx.RECALL_TARGET)} AS target, recall >= {dbl(lx.RECALL_TARGET)} AS passed "
                   "FROM prf",
    "roc_auc": f"""WITH {SCORED}, s AS (
        SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
        FROM scored GROUP BY 1),
        w AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN
              UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
        SELECT CAST(sum(pos) AS BIGINT) AS n_positive, CAST(sum(neg) AS BIGINT) AS n_negative,
               round(sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) AS roc_auc
        FROM w""",
    "class_report": f"""WITH {SCORED}, k AS (
        SELECT * FROM (VALUES (0, 'legitimate'), (1, 'phishing')) v(k, class)),
        c AS (SELECT class, count(*) FILTER (label = k) AS support,
              count(*) FILTER (prediction = k) AS predicted,
              count(*) FILTER (label = k AND prediction = k) AS hits FROM k, scored GROUP BY class),
        m AS (SELECT class, support, hits,
              coalesce(hits::DOUBLE / nullif(predicted, 0), 0.0) AS precision,
              coalesce(hits::DOUBLE / nullif(support, 0), 0.0) AS recall FROM c WHERE support > 0),
        f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1
              FROM m),
        r AS (SELECT class, precision, recall, f1, support FROM f
        UNION ALL SELECT 'accuracy', sum(hits)::DOUBLE / sum(support), sum(hits)::DOUBLE /
          sum(support), sum(hits)::DOUBLE / sum(support), CAST(sum(support) AS BIGINT) FROM f
        UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1),
          CAST(sum(support) AS BIGINT) FROM f
        UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
          sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
          CAST(sum(support) AS BIGINT) FROM f)
        SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1, 6) AS f1, support FROM r""",
    "smoke_scores": f"""WITH {SCORED} SELECT count(*) AS n_rows, round(min(score), 6) AS min_score,
        round(max(score), 6) AS max_score, bool_and(score BETWEEN 0 AND 1) AS valid FROM scored""",
    "tokens": f"WITH {PREPARED} SELECT msg_id, array_to_string(t, ' ') AS result FROM tokens",
    "ngrams": f"WITH {PREPARED} SELECT msg_id, array_to_string(g, '|') AS result FROM grams",
    "term_freq": f"WITH {PREPARED}, {TF} SELECT msg_id, term, tf FROM tf",
    "doc_freq": f"WITH {PREPARED}, {TF} SELECT term, df, total FROM df",
    "vocabulary": f"WITH {PREPARED}, {TF} SELECT term, df, total FROM vocab",
    "tfidf": f"""WITH {PREPARED}, {TF}, n AS (SELECT count(*) AS n FROM prepared),
        w AS (SELECT msg_id, term, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w
              FROM tf JOIN vocab USING (term), n)
        SELECT msg_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY msg_id)), 6) AS weight
        FROM w""",
    "stream_classify": over_stages(FLAT, STREAM_MAILS),
    "stream_dedup": f"""WITH {STREAM_MAILS}, hashed AS (
          SELECT {HASH} AS content_hash, msg_id, ts FROM mails),
        followed AS (
          SELECT *, lag(ts) OVER (PARTITION BY content_hash ORDER BY ts, msg_id) AS before
          FROM hashed)
        SELECT content_hash, msg_id, ts::BIGINT AS event_ts FROM followed
        WHERE before IS NULL OR before + 2 * 86400 < ts""",
    "stream_label_counts": f"""WITH {STREAM_MAILS}, {CLEAN}, {FEATURES}, {STAGES},
        t AS (SELECT s.*, m.ts - m.ts % 3600 AS window_start FROM stages s JOIN mails m USING (msg_id))
        SELECT CAST(window_start AS BIGINT) AS window_start, {LABEL} AS label, gated,
               count(*) AS n FROM t GROUP BY 1, 2, 3""",
}
