"""The 32-feature projection: one narrow pass, no shuffle.

Each ``select`` below exists so that an expensive intermediate (decoded body, visible
text, cleaned text, URLs) is computed once and then referenced by name. Catalyst keeps
such stages apart because the intermediates are used more than once.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscreen import lexicons as lx
from mailscreen.functions import counted, entropy, text, urls
from mailscreen.params import TextOptions
from mailscreen.session import settled


def clean_mails(
    df: DataFrame, options: TextOptions = TextOptions(), keep: list[str] | None = None
) -> DataFrame:
    """Cleaned subject and body, URLs and markup flags next to the ``keep`` columns.

    Raw text is dropped here, so later stages never carry it.
    """
    keep = [c for c in df.columns if c not in ("subject", "body")] if keep is None else keep
    decoded = df.select(
        *keep,
        text.clean_subject(F.col("subject")).alias("subject_clean"),
        F.coalesce("body", F.lit("")).alias("_raw"),
        text.unescape(F.coalesce("body", F.lit(""))).alias("_decoded"),
    )
    stripped = decoded.select(
        "*", text.strip_unescaped_html(F.col("_decoded")).alias("_stripped")
    )
    cleaned = stripped.select(
        *keep,
        "subject_clean",
        text.tidy(F.col("_stripped"), options.fold_unicode).alias("body_clean"),
        urls.urls_of(F.col("_decoded"), F.col("_stripped")).alias("urls"),
        text.has_html(F.col("_raw")).alias("has_html"),
        text.has_form(F.col("_raw")).alias("has_form"),
        text.has_iframe(F.col("_raw")).alias("has_iframe"),
    )
    return settled(cleaned, "clean")


def _counts(options: TextOptions, in_kernel: bool) -> dict[str, Column]:
    """Counts on cleaned mails by name, and whatever the kernel returns as ``_kernel``."""
    s, b, u = (F.col(c) for c in ("subject_clean", "body_clean", "urls"))
    ascii_only, fold = options.fold_unicode, options.fold_lexicon
    if in_kernel and ascii_only:
        return {"_kernel": counted.mail_counts(s, b, u, fold)}
    both = F.concat(s, F.lit(" "), b)
    return {
        "urgency_word_count": text.count_urgency(both, fold),
        "brand_mention_count": text.count_brands(both),
        "body_word_count": text.word_count(b),
        "body_digit_count": text.count_digits(b, ascii_only),
        "body_special_char_count": text.count_special(b, ascii_only),
        "_kernel": entropy.mail_entropies(s, b, u),
    }


def metadata_features(
    df: DataFrame,
    options: TextOptions = TextOptions(),
    keep: list[str] | None = None,
    in_kernel: bool = True,
) -> DataFrame:
    """The ``keep`` columns, the 32 features and the cleaned subject and body.

    ``in_kernel`` counts in the Arrow stage that finds the entropies; without it that stage
    falls away where no entropy is asked for. Text that is not folded is counted natively.
    """
    keep = [c for c in df.columns if c not in ("subject", "body")] if keep is None else keep
    s, b, u, d = (F.col(c) for c in ("subject_clean", "body_clean", "urls", "domains"))
    ascii_only = options.fold_unicode
    fold = options.fold_lexicon
    in_kernel = in_kernel and ascii_only

    cleaned = clean_mails(df, options, keep)
    with_terms = cleaned.select(
        "*",
        urls.extract_domains(u).alias("domains"),
        text.count_exclaim(s).alias("subject_exclamations"),
        *(count.alias(name) for name, count in _counts(options, in_kernel).items()),
    )
    if in_kernel:
        kernel = F.col("_kernel")
        with_terms = with_terms.withColumns({
            "urgency_word_count": kernel["urgency"],
            "brand_mention_count": kernel["brands"],
            "body_word_count": F.when(b == "", 0).otherwise(kernel["spaces"] + 1),
            "body_digit_count": kernel["digits"],
            "body_special_char_count": kernel["special"],
        })
    # in collapsed ASCII text whatever is not a digit, sign or space is a letter
    letters = None
    if ascii_only:
        letters = (
            F.length(b)
            - F.col("body_digit_count")
            - F.col("body_special_char_count")
            - F.greatest(F.col("body_word_count") - 1, F.lit(0))
        )
    upper = (
        text.share_of_letters(F.col("_kernel.upper"), letters) if in_kernel
        else text.ratio_uppercase(b, ascii_only, letters)
    )
    exclamations = F.col("_kernel.exclaim") if in_kernel else text.count_exclaim(b)
    subject_urgency = F.col("_kernel.subject_urgency") > 0 if in_kernel else text.has_urgency(s, fold)
    subject_brand = F.col("_kernel.subject_brands") > 0 if in_kernel else text.has_brand(s)
    computed: dict[str, Column] = {
        "subject_length": F.length(s),
        "body_length": F.length(b),
        "body_entropy": F.round("_kernel.body", 4),
        "ratio_uppercase_body": upper,
        "ratio_uppercase_subject": text.ratio_uppercase(s),
        "exclamation_count": exclamations + F.col("subject_exclamations"),
        "num_urls": F.size(u),
        "num_unique_domains": F.size(d),
        "has_url": F.size(u) > 0,
        "has_ip_url": urls.has_ip_url(u),
        "has_url_shortener": urls.has_shortener(d),
        "num_suspicious_tlds": urls.count_risky_tlds(d),
        "max_url_entropy": F.round("_kernel.urls", 4),
        "avg_url_length": urls.avg_url_length(u),
        "num_redirect_params": urls.count_redirects(u),
        "max_url_length": urls.max_url_length(u),
        "has_urgency_words": F.col("urgency_word_count") > 0,
        "has_brand_mention": F.col("brand_mention_count") > 0,
        "subject_is_empty": s == "",
        "subject_has_re_fwd": text.is_reply_forward(s),
        "subject_entropy": F.round("_kernel.subject", 4),
        "subject_has_urgency": subject_urgency,
        "subject_has_brand": subject_brand,
    }
    features = with_terms.select(
        *keep,
        *(
            computed.get(name, F.col(name)).cast(lx.FEATURE_TYPES[name]).alias(name)
            for name in lx.FEATURES
        ),
        "subject_clean",
        "body_clean",
    )
    return settled(features, "features")


def feature_record() -> Column:
    """The 32 feature columns packed into one struct, canonical order."""
    return F.struct(*lx.FEATURES)


def as_numbers(df: DataFrame) -> DataFrame:
    """Feature columns as doubles: booleans become 0/1, missing values 0."""
    return df.withColumns(
        {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in lx.FEATURES}
    )


def feature_vector(df: DataFrame, output: str = "features") -> DataFrame:
    """Append the model vector; the feature columns themselves stay as they are.

    The width is fixed by the canonical list, and the assembler rejects NaN.
    """
    keep = df.columns
    missing = [n for n in lx.FEATURES if n not in keep]
    numbers = df.select(
        *keep,
        *(
            (
                F.lit(0.0) if n in missing else F.coalesce(F.col(n).cast("double"), F.lit(0.0))
            ).alias(f"_v_{n}")
            for n in lx.FEATURES
        ),
    )
    assembler = VectorAssembler(
        inputCols=[f"_v_{n}" for n in lx.FEATURES], outputCol=output, handleInvalid="error"
    )
    return assembler.transform(numbers).select(*keep, output)


def text_corpus(
    df: DataFrame, options: TextOptions = TextOptions(), keep: list[str] | None = None
) -> DataFrame:
    """The ``keep`` columns and the prepared model text."""
    keep = [c for c in df.columns if c not in ("subject", "body")] if keep is None else keep
    return clean_mails(df, options, keep).select(
        *keep,
        text.prepare_text(F.col("subject_clean"), F.col("body_clean"), options).alias(
            "prepared_text"
        ),
    )


def extract_quality(df: DataFrame, options: TextOptions = TextOptions()) -> DataFrame:
    """One row on an extraction run: rows, incomplete rows, empty texts, mean length."""
    prepared = metadata_features(df, options, keep=[]).select(
        F.greatest(*(F.col(n).isNull().cast("int") for n in lx.FEATURES)).alias("failed"),
        text.prepare_text(F.col("subject_clean"), F.col("body_clean"), options).alias("t"),
    )
    return prepared.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.sum("failed"), F.lit(0)).cast("bigint").alias("n_failed"),
        F.count_if(text.is_blank(F.col("t"))).alias("n_empty"),
        F.round(F.avg(F.length("t")), 4).alias("mean_length"),
    )
