import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytogrid.functions import expressions, prompts, ranking, replies
from cytogrid.functions.skew import attach


def percentile_of_score(ref, q):
    ref = np.asarray(ref)
    below, upto = (ref < q).sum(), (ref <= q).sum()
    return (below + upto + (upto > below)) * 50.0 / len(ref)


@pytest.fixture(scope="module")
def scored_input(spark):
    rng = np.random.default_rng(3)
    ref = [(g, float(v)) for g in ("a", "b") for v in rng.integers(0, 40, 300) / 4]
    ref += [("flat", 2.0)] * 5 + [("a", None)]
    query = [(i, g, float(v)) for i, (g, v) in enumerate(
        [("a", 3.25), ("a", 3.3), ("a", -1), ("a", 99), ("b", 0), ("flat", 2.0)])] + [(9, "b", None)]
    return (spark.createDataFrame(ref, "g string, value double"),
            spark.createDataFrame(query, "id int, g string, value double"), ref)


@pytest.mark.parametrize("per_bin", [4, 10**6])
def test_scores_match_numpy(scored_input, per_bin):
    ref, query, values = scored_input
    got = ranking.score_against(ref, query, ["g"], per_bin=per_bin).collect()
    assert len(got) == 7
    for r in got:
        group = np.array([v for g, v in values if g == r.g and v is not None])
        if r.value is None:
            assert r.z is None and r.percentile is None
            continue
        assert r.percentile == pytest.approx(percentile_of_score(group, r.value))
        if r.g == "flat":
            assert r.z is None
        else:
            assert r.z == pytest.approx((r.value - group.mean()) / group.std())


@pytest.mark.parametrize("per_bin", [4, 10**6])
def test_self_scores(scored_input, per_bin):
    ref, _, _ = scored_input
    known = ref.where("value IS NOT NULL AND g <> 'flat'").withColumn("id", F.monotonically_increasing_id())
    got = ranking.score_against(known, None, ["g"], per_bin=per_bin)
    stats = got.groupBy("g").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s"),
                                 F.min("percentile").alias("low"), F.max("percentile").alias("high"))
    for r in stats.collect():
        assert r.m == pytest.approx(0, abs=1e-9) and r.s == pytest.approx(1)
        assert 0 < r.low and r.high <= 100


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    data = {g: np.round(rng.lognormal(size=n), 2) for g, n in (("a", 501), ("b", 3), ("c", 1))}
    rows = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, value double")
    got = ranking.exact_quantiles(rows, ["g"], {"q2": 0.2, "q95": 0.95})
    for r in got.collect():
        assert [r.q2, r.q95] == pytest.approx(list(np.quantile(data[r.g], [0.2, 0.95])))


def test_quantiles_of_large_groups(spark):
    """Brackets narrower than the group: ties over a third of the rows, the ends, a group without values."""
    rows = spark.range(300_000, numPartitions=4).select(
        (F.col("id") % 3 % 2).alias("g"),
        F.when(F.col("id") % 7 < 3, 0.25).otherwise(F.pmod(F.hash("id"), F.lit(100_003)) / 100_003).alias("value"))
    empty = spark.createDataFrame([(5, None), (6, 1.5), (6, None)], "g long, value double")
    wanted = {"q0": 0.0, "q2": 0.2, "q5": 0.5, "q95": 0.95, "q1": 1.0}
    got = {r.g: r for r in ranking.exact_quantiles(rows.union(empty), ["g"], wanted).collect()}
    frame = rows.toPandas()
    for g in (0, 1):
        want = np.quantile(frame.loc[frame["g"] == g, "value"], list(wanted.values()))
        assert [got[g][n] for n in wanted] == pytest.approx(list(want), abs=1e-15)
    assert [got[5][n] for n in wanted] == [None] * 5 and [got[6][n] for n in wanted] == [1.5] * 5
    assert ranking.exact_quantiles(rows.where("g > 9"), ["g"], wanted).collect() == []


def test_binned_running_counts(spark):
    values = np.random.default_rng(7).normal(size=5000) ** 3
    rows = spark.createDataFrame([("a", float(v)) for v in values], "g string, value double")
    got = ranking.running_counts(rows, ["g"], per_bin=100, bins=16).toPandas().sort_values("value")
    assert (got["n_below"].to_numpy() == np.arange(5000)).all()
    assert set(got["n_total"]) == {5000}


def test_number_text_rounds_like_python(spark):
    values = [2.5, 0.25, 0.35, -0.04, 1234.56, 0.05, 99.5, -1.25, 1e6 + 0.5]
    for digits in (0, 1, 2):
        got = spark.createDataFrame([(v,) for v in values], "v double").select(
            expressions.fixed(F.col("v"), digits).alias("t")).collect()
        assert [r.t for r in got] == [f"{v:.{digits}f}" for v in values]


def test_attach_keeps_hot_keys_whole(spark):
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 7))
    lookup = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k long, v string")
    inner = attach(rows.withColumn("k", F.col("k").cast("long")), lookup, ["k"], ["id"])
    assert inner.count() == rows.where("k < 5").count()
    left = attach(rows.withColumn("k", F.col("k").cast("long")), lookup, ["k"], ["id"], "left")
    assert left.count() == 5000


def python_parse(text):
    """Plain restatement of the rules for replies."""
    lines = text.split("\n")

    def guess(i, reach):
        more = [x for x in lines[i + 1:i + 1 + reach] if len(x) < 50 and "evidence" not in x.lower()]
        return "\n".join([lines[i], *more])

    heads = {m: next((i for i, x in enumerate(lines) if x.startswith(m)), None) for m in ("1.", "2.")}
    found = sorted(i for i in heads.values() if i is not None)
    return [guess(i, 2) for i in found] or [guess(0, 4)]


REPLIES = [
    "1. **Glomeruli**:\nshort\nEvidence: x\n2. **Vessel**:\nabc",
    "2. second first\n1. then one\nmore",
    "1. one\n2. right after\nx\ny",
    "no numbers\n" + "a" * 49 + "\n" + "b" * 50 + "\nevIDence\nlast\nnot reached",
    "", "1.", "x\n1. a\n1. b\n" + "c" * 49,
]


def test_parse_response(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(REPLIES)], "i int, t string")
    got = {r.i: r.g for r in df.select("i", replies.parse_response(F.col("t")).alias("g")).collect()}
    assert [got[i] for i in range(len(REPLIES))] == [python_parse(t) for t in REPLIES]


def test_guess_lengths(spark):
    text = "*".join(["a" * 5, " \t" + "b" * 6 + "\n", "c" * 99, "d" * 100, "1.: efghij"])
    got = spark.createDataFrame([(text,)], "t string").select(replies.parse_guess(F.col("t")).alias("g")).first().g
    assert got == ["b" * 6, "c" * 99, "efghij"]


def test_label_rules_in_order(spark):
    cases = {
        "Peritubular capillaries": "Glomeruli", "Renal Vasculature": "Blood vessel",
        "Distal convoluted tubule": "Distal tubules", "PROXIMAL tubule": "Proximal tubules",
        "collecting tubule": "Proximal tubules", "tub, proximal": "Proximal tubules",
        "Basement membrane": "Interstitium", "immune cells": "Interstitium", "stroma": "NA",
        "glomerular blood vessel": "Glomeruli", "distal end": "NA",
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = {r.t: r.l for r in df.withColumn("l", replies.guess_to_label(F.col("t"))).collect()}
    assert got == cases


def test_prompt_variables(spark):
    section = {"variables": ["a", "b"], "template": "<{a}|{b}>"}
    with pytest.raises(KeyError):
        prompts.format_prompt(section, {"a": F.lit("x")})
    df = spark.createDataFrame([("{b}", "y")], "a string, b string")
    text = df.select(prompts.format_prompt(section, {"a": F.col("a"), "b": F.col("b")}).alias("t")).first().t
    assert text == "<{b}|y>"
    empty = df.withColumn("b", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="prompt variable b is NULL"):
        empty.select(prompts.format_prompt(section, {"a": F.col("a"), "b": F.col("b")})).collect()


def test_prompt_files_declare_their_variables():
    for agent in ("context_curator", "omics_annotator", "omics_annotator_aggregate", "pathology_scorer"):
        assert prompts.load_prompts(agent)


def test_relevance_scores(spark):
    given = {
        "**Phenotype-driven interpretation**:\n   DKD, **85**\n   1. evidence, 12": 85, "DKD 2A, 100/100.": 100, "x, 101": None,
        "x, relevance score: 40": 40, "Relevance Score (0-100): 85": 85, "Relevance Score (0-100)": None, "score of\nrelevance is 7": 7, "1. a, 5\nb, 9": None, "": None, None: None,
    }
    frame = spark.createDataFrame([(r,) for r in given], "reply string")
    found = {r.reply: r.score for r in frame.select("reply", replies.relevance_score(F.col("reply")).alias("score")).collect()}
    assert found == given


def test_quantiles_of_values_that_differ_when_worked_out_again(spark):
    def drawn(batches):
        for batch in batches:
            noise = np.random.default_rng().random(batch.num_rows)  # another one in every pass
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(noise)], ["g", "value"])

    rows = spark.range(0, 20000, 1, 2).select((F.col("id") % 2).alias("g")).mapInArrow(drawn, "g long, value double")
    found = ranking.exact_quantiles(rows, ["g"], {"low": 0.2, "middle": 0.5}).collect()
    assert len(found) == 2
    for row in found:
        assert abs(row["low"] - 0.2) < 0.05 and abs(row["middle"] - 0.5) < 0.05
