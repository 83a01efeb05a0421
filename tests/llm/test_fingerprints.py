from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import fingerprints as fp
from tessera.llm.common import table
from tessera.llm.queries import op6_document_fingerprints
from tests.llm.helpers import no_documents, odd_documents


def edited(docs):
    """(id, text) pairs in order to their edited texts."""
    out = []
    for i, (_, t) in enumerate(docs):
        half = len(t) // 2
        out.append(t[: len(t) - half] + docs[(i + 1) % len(docs)][1][:half])
    return out


def grams(t):
    ws = t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    ws = [w for w in ws if w]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_table_against_brute_force(spark, small):
    docs = sorted((r["doc_id"], r["text"] or "") for r in table(spark, small, "documents").collect())
    rows = {r["doc_id"]: r for r in op6_document_fingerprints(spark, small).collect()}
    assert len(rows) == len(docs)
    by_text, errors = {}, []
    for i, ((key, text), new) in enumerate(zip(docs, edited(docs), strict=True)):
        r = rows[key]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == sha256(new.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        wanted = likeness(grams(text), grams(new)), likeness(grams(text), grams(docs[(i + 1) % len(docs)][1]))
        errors.append((r["near_edited"] - wanted[0], r["near_next"] - wanted[1]))
    errors = np.array(errors)
    assert np.abs(errors).max() < 0.25 and np.abs(errors).mean() < 0.03
    assert np.abs(errors.mean(0)).max() < 0.02  # no bias


def test_odd_documents(spark):
    df = odd_documents(spark)
    rows = fp.edited_fingerprints(df).collect()
    assert len(rows) == df.count()
    given = df.dropDuplicates(["doc_id"]).where("doc_id is not null").count()
    assert len({r["doc_id"] for r in rows if r["doc_id"] is not None}) == given
    assert fp.edited_fingerprints(no_documents(spark)).count() == 0
    lone = fp.edited_fingerprints(df.where("doc_id = 5")).collect()
    assert len(lone) == 3 and all(r["near_next"] == 1.0 for r in lone)


def test_order_by_ranges(spark):
    ids = spark.range(1000).select((F.col("id") * 37 % 1000).alias("a")).repartition(7)
    got = {r["a"]: r["next"]["a"] for r in fp.following(ids, ["a"]).collect()}
    assert got == {i: (i + 1) % 1000 for i in range(1000)}


def test_sketches_merge_and_estimate(spark):
    base = [f"w{i}" for i in range(4000)]
    a, b = " ".join(base[:3000]), " ".join(base[1000:])
    df = spark.createDataFrame([(a, b, " ".join(base))], "a string, b string, c string")
    for c in "abc":
        df = fp.with_sketch(df, c, f"s{c}", 512)
    a, b, c = (F.col(f"s{x}") for x in "abc")
    r = df.select(
        fp.resemblance(a, b, 512).alias("r"),
        fp.containment(a, c, 512).alias("c"),
        fp.distinct_shingles(a, 512).alias("n"),
        (fp.from_string(fp.as_string(a)) == a).alias("same"),
        fp.resemblance(fp.merged(a, b, 512), c, 512).alias("m"),
    ).first()
    assert abs(r["r"] - 0.5) < 0.1 and r["c"] > 0.85 and abs(r["n"] / 2996 - 1) < 0.15 and r["same"] and r["m"] > 0.95


def test_main_path_is_native(spark, small):
    plan = op6_document_fingerprints(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
