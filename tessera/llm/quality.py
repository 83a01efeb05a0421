"""Quality rules: a threshold table compiled into one projection.

All measures are column expressions; there are no user functions and no
shuffle, so the cost is one pass over the texts.

Defined cases: a null, empty or blank text has no words and fails the base
rule; ties do not arise; repeated rows are judged one by one; an empty table
gives an empty result; the measures are added under names chosen by the caller's
prefix, so clashing extra columns are left alone.  Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import filtered, window_hashes, words

#: Frequent function words of the languages that the rules know.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are with as be this by from or at an a have not but".split(),
    "fr": "le la les de des et en un une du que qui dans pour par sur est pas au avec ce il".split(),
    "de": "der die das und in zu den von mit für auf ist im dem nicht ein eine des sich als".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= measure / per <= high, or if it has fewer than from_words words."""

    name: str
    measure: str
    per: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The threshold table.  Ratios are over the text's own counts.
RULES = (
    Rule("word_length", "word_chars", "n_words", low=2.0, high=12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("exclamations", "n_exclamations", "n_words", high=0.3),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.4),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, from_words=50),
)

WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_lines", "n_stop_words")


def repeated_words(df: DataFrame, ws: str, out: str) -> DataFrame:
    """Adds the number of words that lie in a window of five found twice or more in the same text.

    Hashes of the windows tell which texts have no repeat at all; the others
    sort the windows themselves, so that a hash collision changes nothing.
    Linear in the text but for that sort.
    """
    hs, h, s, at = f"{out}_hs", f"{out}_h", f"{out}_s", f"{out}_at"
    n = F.size(ws)
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW))
    df = df.withColumn(hs, F.transform(F.col(ws), lambda w: F.xxhash64(w))).withColumn(h, window_hashes(F.col(hs), starts, WINDOW))
    repeats = F.size(F.array_distinct(h)) < F.size(h)
    windows = F.transform(starts, lambda i: F.struct(F.array_join(F.slice(F.col(ws), i + 1, WINDOW), " ").alias("g"), i.alias("i")))
    df = df.withColumn(s, F.when(repeats, F.sort_array(windows)))

    def same(e: Column, j: Column) -> Column:
        near = [e["g"] == F.get(F.col(s), j + step)["g"] for step in (-1, 1)]
        return F.coalesce(near[0], F.lit(False)) | F.coalesce(near[1], F.lit(False))

    df = df.withColumn(at, F.sort_array(F.transform(F.filter(F.col(s), same), lambda e: e["i"])))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["total"] + F.least(F.lit(WINDOW), i + WINDOW - acc["end"])).alias("total"), (i + WINDOW).alias("end")),
        lambda acc: acc["total"],
    )
    return df.withColumn(out, F.coalesce(covered, F.lit(0)).cast("long")).drop(hs, h, s, at)


def measures(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Adds the measures of the rules as long columns, each named prefix + measure."""
    p = {m: prefix + m for m in MEASURES}
    ws, lines = f"{prefix}_ws", f"{prefix}_lines"
    body = F.coalesce(F.col(text), F.lit(""))
    found = lambda c: F.octet_length(body) - F.octet_length(F.replace(body, F.lit(c), F.lit("")))
    stop = sorted({w for ws_ in STOP_WORDS.values() for w in ws_})
    df = df.withColumn(ws, words(F.col(text)))
    df = df.withColumn(lines, F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = repeated_words(df, ws, p["n_repeat_words"])
    return df.withColumns(
        {
            p["n_words"]: F.size(ws).cast("long"),
            p["word_chars"]: F.char_length(F.array_join(ws, "")).cast("long"),
            p["n_symbols"]: sum((found(c) for c in "#*$%&|<>"), F.lit(0)).cast("long"),
            p["n_exclamations"]: found("!").cast("long"),
            p["n_lines"]: F.size(lines).cast("long"),
            p["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            p["n_stop_words"]: F.size(F.filter(F.col(ws), lambda w: w.isin(stop))).cast("long"),
        }
    ).drop(ws, lines)


def base_failed(prefix: str = "") -> Column:
    n, repeat = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < 10) | (100 * repeat > 20 * n)


def passes(rules: tuple[Rule, ...] = RULES, prefix: str = "") -> Column:
    """The table as one boolean expression; a ratio over nothing passes."""
    out = F.lit(True)
    for r in rules:
        value, per = F.col(prefix + r.measure).cast("double"), F.col(prefix + r.per)
        fits = F.lit(True)
        if r.low is not None:
            fits &= value >= r.low * per
        if r.high is not None:
            fits &= value <= r.high * per
        out &= (F.col(f"{prefix}n_words") < r.from_words) | fits
    return out


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """Adds the measures, base_failed and kept."""
    df = measures(df, text, prefix).withColumn(f"{prefix}base_failed", base_failed(prefix))
    return df.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & passes(rules, prefix))


def keep_good(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text is kept, with their own columns only."""
    p = "_quality_"
    return filtered(judge(df, text, rules, p), F.col(f"{p}kept")).select(*[F.col(f"`{c}`") for c in df.columns])
