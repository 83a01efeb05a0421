"""URL filters: rules by host and path, and boosted trees on lexical features.

Rules and trees are compiled into column expressions.  Counts and shares by
suffix and section are taken over all labelled URLs, and joined as tables.  Only
the trees are fitted on the driver, on a bounded sample: of the distinct labelled
URLs those whose hashes are below a threshold, which lets train_rows of them pass
at most.  The statistics of a row that the trees are fitted on leave out the fold
of URLs that it belongs to, so that no label is seen through them.

Defined cases: a null URL or one without :// has an empty host and path, fits
no rule and is judged by its features like any other; repeated URLs are judged
alike and count once in training; URLs of any length are read whole; with no
labelled URL, or labels of one kind, the trees say that kind, or allow; other
columns stay, but for those named like a result, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, forget, free_prefix, written

#: rule -> verdict.  A rule is a host, which covers its subdomains, and how paths start.
RULES = {
    "com/en/": "block",
    "example.com/en/7": "allow",
    "net/de/": "allow",
    "example.net/de/8": "block",
    "org/es/": "block",
}
#: Words that mark a host as unwanted when they stand alone in it; they label URLs for training.
SEED_WORDS = (
    "adult ads adserver bet bets casino escort gambling jackpot lottery payday pharmacy pills poker porn sex slots spam viagra xxx".split()
)
#: URLs that the trees are fitted on at most, and folds of URLs that their statistics leave out.
TRAIN_ROWS, FOLDS = 20_000, 5
LEXICAL = (
    "url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "letter_ratio",
    "entropy", "parameters", "query_length", "hyphens", "last_segment_length", "has_fragment", "secure",
)
FEATURES = (*LEXICAL, "suffix_share", "suffix_log_count", "section_share", "section_log_count")


def parts(url: Column) -> tuple[Column, Column]:
    """Host, with A to Z lower-cased, and path."""
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, shape, 1)), F.regexp_extract(u, shape, 2)


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: dict[str, str] = RULES) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules.items():
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.char_length(text)
    seen = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    share = lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n
    return F.when(n == 0, 0.0).otherwise(F.aggregate(seen, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))))


def with_features(df: DataFrame, url: str = "url", prefix: str = "") -> DataFrame:
    """Adds host, path and the lexical features, and the suffix and section that the statistics go by."""
    p = prefix
    df = df.withColumn(f"{p}u", F.coalesce(F.col(url), F.lit("")))
    host, path = parts(F.col(f"{p}u"))
    df = df.withColumns({f"{p}host": host, f"{p}path": path})
    u, host, path = F.col(f"{p}u"), F.col(f"{p}host"), F.col(f"{p}path")
    count = lambda c, what: F.regexp_count(c, F.lit(what)).cast("double")
    size = lambda c: F.char_length(c).cast("double")
    query = F.regexp_extract(u, r"(?s)^[^?#]*\?([^#]*)", 1)
    found = {
        "url_length": size(u),
        "host_length": size(host),
        "path_length": size(path),
        "host_depth": count(host, r"\."),
        "path_depth": count(path, "/"),
        "digit_ratio": count(u, "[0-9]") / F.greatest(size(u), F.lit(1.0)),
        "letter_ratio": count(u, "[A-Za-z]") / F.greatest(size(u), F.lit(1.0)),
        "entropy": _entropy(u),
        "parameters": count(query, "[^&]+"),
        "query_length": size(query),
        "hyphens": count(u, "-"),
        "last_segment_length": size(F.regexp_extract(path, r"(?s)([^/]*)\z", 1)),
        "has_fragment": u.contains("#").cast("double"),
        "secure": F.lower(F.substring(u, 1, 6)).eqNullSafe("https:").cast("double"),
        "suffix": F.regexp_extract(host, r"(?s)([^.]*)\z", 1),
        "section": F.concat_ws("/", F.regexp_extract(host, r"(?s)([^.]*)\z", 1), F.regexp_extract(path, r"(?s)^/([^/]*)/", 1)),
    }
    return df.withColumns({p + k: v for k, v in found.items()})


def joined_share(df: DataFrame, table: DataFrame | None, kind: str, prior: float, on: list[str], prefix: str = "") -> DataFrame:
    """Adds prefix + kind + _share and _log_count from a table whose first columns are met by the columns on."""
    names = {f"{prefix}{kind}_{n}": n for n in ("share", "log_count")}
    if table is not None:
        keys = [F.col(k).alias(c) for k, c in zip(table.columns, on, strict=False)]
        df = df.join(table.select(*keys, *[F.col(n).alias(c) for c, n in names.items()]), on, "left")
    known = lambda c: F.col(c) if table is not None else F.lit(None).cast("double")
    return df.withColumns({c: F.coalesce(known(c), F.lit(prior if n == "share" else 0.0)) for c, n in names.items()})


@dataclass
class UrlModel:
    """Boosted trees as nested tuples (feature, threshold, left, right) or a leaf value; shares holds tables (key, share, log_count) by kind."""

    base: float
    prior: float
    trees: list = field(default_factory=list)
    shares: dict[str, DataFrame] = field(default_factory=dict)

    def with_shares(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Adds the statistics among FEATURES to what with_features() adds; an unknown key has the mean share and count 0."""
        for kind in ("suffix", "section"):
            df = joined_share(df, self.shares.get(kind), kind, self.prior, [prefix + kind], prefix)
        return df

    def score(self, prefix: str = "") -> Column:
        """Log odds of block over columns of FEATURES."""

        def tree(t) -> Column:
            if isinstance(t, float):
                return F.lit(t)
            return F.when(F.col(prefix + FEATURES[t[0]]) <= t[1], tree(t[2])).otherwise(tree(t[3]))

        out = F.lit(self.base)
        for t in self.trees:
            out = out + tree(t)
        return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 10) -> tuple[float, list]:
    """Gradient boosting of the log loss with histogram splits."""
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)

    def gain(g, h):
        return g * g / (h + 1.0)

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if level < depth and len(rows) >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                k = codes[rows, f]
                hist = [np.cumsum(np.bincount(k, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None)]
                value = gain(hist[0], hist[1]) + gain(total_g - hist[0], total_h - hist[1]) - gain(total_g, total_h)
                value[(hist[2] < least) | (len(rows) - hist[2] < least)] = 0
                i = int(value.argmax())
                if value[i] > best[0]:
                    best = (value[i], f, i)
        if best[1] is None:
            return float(rate * total_g / (total_h + 1.0))
        _, f, i = best
        left = codes[rows, f] <= i
        return f, float(cuts[f][i]), build(rows[left], g, h, level + 1), build(rows[~left], g, h, level + 1)

    def apply(t, rows: np.ndarray, out: np.ndarray) -> None:
        if isinstance(t, float):
            out[rows] += t
        else:
            left = x[rows, t[0]] <= t[1]
            apply(t[2], rows[left], out)
            apply(t[3], rows[~left], out)

    everything, score, grown = np.arange(len(y)), np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        t = build(everything, y - p, p * (1 - p), 0)
        grown.append(t)
        apply(t, everything, score)
    return base, grown


def fit(labelled: DataFrame, url: str = "url", label: str = "label", train_rows: int = TRAIN_ROWS, least: int = 20) -> UrlModel:
    """Fits the trees on at most train_rows labelled URLs (label 1: block); the statistics cover all of them.

    A suffix or section with fewer than least URLs gets the mean share.
    """
    known = labelled.where(F.col(label).isNotNull()).groupBy(F.col(url).alias("url")).agg(F.max(label).cast("double").alias("label"))
    known = written(with_features(known).select("url", "label", "suffix", "section", _fold().alias("fold")), "labelled")
    total = known.agg(F.count("*").alias("n"), F.avg("label").alias("prior")).first()
    prior = float(total["prior"] or 0.0)
    if not total["n"] or prior in (0.0, 1.0):
        forget(known)
        return UrlModel(2 * prior - 1, prior) if total["n"] else UrlModel(-1.0, 0.5)
    model = UrlModel(0.0, prior)
    # the share of hashes that pass is a little less than asked for, as how many URLs pass is a matter of chance
    span = 1 << 30
    passing = span if total["n"] <= train_rows else int(span * max(0.0, train_rows - 3 * train_rows**0.5) / total["n"])
    sample = with_features(known.where(F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(span)) < passing).select("url", "label", "fold"))
    for kind in ("suffix", "section"):
        folds = known.groupBy(F.col(kind).alias("key"), "fold").agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
        # written before they are joined, so that the engine knows their size and can split a hot key
        folds = written(folds, f"url-{kind}-folds")
        counts = written(folds.groupBy("key").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked")).where(F.col("n") >= least), f"url-{kind}")
        model.shares[kind] = counts.select("key", *_share(F.col("n"), F.col("blocked"), prior))
        others = counts.select("key", F.col("n").alias("all"), F.col("blocked").alias("all_blocked")).join(folds, "key")
        others = others.withColumns({"n": F.col("all") - F.col("n"), "blocked": F.col("all_blocked") - F.col("blocked")}).where(F.col("n") > 0)
        sample = joined_share(sample, others.select("key", "fold", *_share(F.col("n"), F.col("blocked"), prior)), kind, prior, [kind, "fold"])
    rows = sorted(tuple(map(float, r)) for r in sample.select(*FEATURES, "label").collect())[:train_rows]
    forget(known)
    if len({r[-1] for r in rows}) < 2:
        return UrlModel(2 * prior - 1, prior, [], model.shares)
    x = np.array(rows)
    model.base, model.trees = grow(x[:, :-1], x[:, -1])
    return model


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(FOLDS)).cast("int")


def _share(n: Column, blocked: Column, prior: float) -> tuple[Column, Column]:
    """The share of blocked URLs, drawn towards the mean where there are few, and the count."""
    return ((blocked + 10 * prior) / (n + 10)).alias("share"), F.log1p(n).alias("log_count")


def by_seed_words(df: DataFrame, url: str = "url") -> DataFrame:
    """(url, label) of the URLs that have a host; label 1 if a seed word stands in it between full stops, hyphens or underscores."""
    host, _ = parts(F.col(url))
    named = F.arrays_overlap(F.split(host, r"[._-]"), F.array(*map(F.lit, SEED_WORDS)))
    return df.where(host != "").select(F.col(url).alias("url"), named.cast("int").alias("label"))


def scored(df: DataFrame, model: UrlModel, url: str = "url", prefix: str = "_url_") -> DataFrame:
    """Adds prefix + host, path and score."""
    out = model.with_shares(with_features(df, url, prefix), prefix)
    out = out.withColumn(f"{prefix}score", model.score(prefix))
    extra = [prefix + c for c in ("u", "suffix", "section", *FEATURES)]
    return out.drop(*extra)


def judge(df: DataFrame, url: str = "url", rules: dict[str, str] = RULES, model: UrlModel | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Adds _url_host, _url_path, _url_rule and _url_verdict.

    Without a model one is trained on the table's own URLs, labelled by the
    seed words; by their shape the trees then know unwanted hosts that no seed
    word names.  Rules are decisions, not labels: they do not train the trees.
    """
    if model is None:
        model = fit(by_seed_words(df, url), train_rows=train_rows)
    results = [f"_url_{c}" for c in ("host", "path", "rule", "verdict")]
    df = df.drop(*results)
    p = free_prefix(df, "url")
    out = scored(df, model, url, p)
    rule = rule_of(F.col(f"{p}host"), F.col(f"{p}path"), rules)
    out = out.withColumn(f"{p}rule", rule)
    by_trees = F.when(F.col(f"{p}score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    verdict = F.coalesce(verdict_of(F.col(f"{p}rule"), rules), by_trees)
    found = (F.col(f"{p}host"), F.col(f"{p}path"), F.col(f"{p}rule"), verdict)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[c.alias(n) for c, n in zip(found, results, strict=True)])
