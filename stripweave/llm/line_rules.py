"""Line-first quality rules: judge every line, drop the failures, then judge what is left.

Built from SQL functions only. Per document nothing is shuffled: words, windows and lines stay in
arrays of the document's own row.

Defined results: null text counts as empty; a text without words has zero counts and fails; empty
tables give empty results; repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, words

#: Fixed value: characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Fixed value: marks that may end a sentence, then closing quotes or brackets.
TERMINAL = r"[.!?…。！？:;][\"'”’»)\]]*$"
SPACE_AT_END = r"[\x20\x09-\x0D]+$"
#: Phrases of page furniture by language, as patterns; a parameter of ``line_quality``.
BOILERPLATE = {
    "any": ("cookies?", "copyright", "log ?in", "newsletter", "javascript", "lorem ipsum"),
    "en": ("privacy policy", "terms of (use|service)", "all rights reserved", "sign ?(in|up)", "subscribe", "click here", "read more", "share (this|on)", "follow us", "back to top", "skip to content", "powered by"),
    "de": ("impressum", "datenschutz(erklärung)?", "alle rechte vorbehalten", "nutzungsbedingungen", "jetzt anmelden", "hier klicken", "mehr lesen", "weiterlesen", "nach oben"),
    "fr": ("mentions légales", "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "cliquez ici", "lire la suite", "abonnez-vous", "haut de page"),
    "es": ("aviso legal", "todos los derechos reservados", "política de privacidad", "condiciones de uso", "haga clic aquí", "leer más", "suscríbete", "volver arriba"),
}


def boilerplate_pattern(phrases: dict[str, tuple[str, ...]]) -> str | None:
    """One pattern, without case, for the phrases of all languages; None without any."""
    parts = [x for some in phrases.values() for x in some]
    return rf"(?i)\b({'|'.join(parts)})\b" if parts else None


def _repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = F.size(w)
    windows = F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            twin = F.filter(
                p,
                lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]),
            )
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        def total(s: Column) -> Column:
            return F.aggregate(
                F.transform(s, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(s, k + 1) - x, F.lit(3)))),
                F.lit(0),
                lambda a, x: a + x,
            )

        return let(let(pairs, starts), total)

    # sorting is only paid for by texts that repeat a window at all
    return let(
        windows,
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)),
    ).cast("long")


def _line_fails(line: Column, min_words: int, max_symbol_share: float, max_upper_share: float, boilerplate: str | None) -> Column:
    """True if a line is punctuation junk, navigation or boilerplate; white space at its ends does not count."""

    def by_shape(x: Column) -> Column:
        dense, n = x["dense"], x["n"]
        size = F.length(dense)
        symbols = size - F.length(F.regexp_replace(dense, SYMBOLS, ""))
        upper = F.length(F.regexp_replace(dense, r"\P{Lu}+", ""))
        bangs = F.when(F.contains(dense, F.lit("!!")), F.regexp_count(dense, F.lit("!!+"))).otherwise(F.lit(0))
        bars = F.when(dense.rlike("[|»>•·]"), F.regexp_count(line, F.lit(r"(^|\s)[|»>•·](?=\s|$)"))).otherwise(F.lit(0))
        return (
            ((n < min_words) & ~F.substring(F.regexp_replace(line, SPACE_AT_END, ""), -12, 12).rlike(TERMINAL))
            | (symbols > max_symbol_share * size)
            | ((size >= 20) & (upper > max_upper_share * size))
            | (bangs * 3 > n)
            | (bars * 4 > n)
            | ((n <= 12) & line.rlike(boilerplate) if boilerplate else F.lit(False))
        )

    space = F.lit(r"[\x20\x09-\x0D]+")
    return let(
        F.struct(F.regexp_replace(line, space, F.lit("")).alias("dense"), F.regexp_count(line, F.lit(WORD)).alias("n")),
        by_shape,
    )


def line_quality(
    docs: DataFrame,
    min_doc_words: int = 50,
    max_repeat_percent: int = 50,
    max_lost_percent: int = 30,
    min_line_words: int = 4,
    max_symbol_share: float = 0.1,
    max_upper_share: float = 0.6,
    boilerplate: dict[str, tuple[str, ...]] = BOILERPLATE,
) -> DataFrame:
    """``doc_id``, base counts, ``base_failed``, ``cleaned`` text, ``kept_chars`` and ``kept``.

    ``kept`` is false if the base rules fail, or if lines failing the line rules hold more than
    ``max_lost_percent`` of the characters in words, or if the rest falls under half of
    ``min_doc_words``.
    """
    text, phrases = F.coalesce(F.col("text"), F.lit("")), boilerplate_pattern(boilerplate)
    lines = docs.select("doc_id", text.alias("t")).select(
        "doc_id", "t", words(F.col("t")).alias("w"), F.split("t", "\n", -1).alias("l")
    )
    base = lines.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(
            F.filter("l", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        ).alias("n_dup_lines"),
        _repeated_words(F.col("w")).alias("n_repeat_words"),
        F.filter(
            "l", lambda x: ~_line_fails(x, min_line_words, max_symbol_share, max_upper_share, phrases)
        ).alias("good"),
    )
    judged = base.select(
        "*",
        ((F.col("n_words") < min_doc_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        F.array_join("good", "\n").alias("cleaned"),
    ).withColumn("kept_chars", F.length(F.regexp_replace("cleaned", r"[\x20\x09-\x0D]+", "")).cast("long"))
    kept = (
        ~F.col("base_failed")
        & (100 * F.col("kept_chars") >= (100 - max_lost_percent) * F.col("word_chars"))
        & (2 * F.regexp_count("cleaned", F.lit(WORD)) >= min_doc_words)
    )
    return judged.withColumn("kept", kept).drop("good")


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op4_line_rules(spark, sf_dir: str) -> DataFrame:
    """Verdict of the line rules on every document."""
    return line_quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(*COLUMNS)
