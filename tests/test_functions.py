import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import arrays, keys, laws, numeric, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_safe_number(spark):
    for text, want in (("1.5", 1.5), ("NaN", None), ("Infinity", None), ("x", None), ("", None), (None, None)):
        assert one(spark, numeric.safe_number(F.lit(text).cast("string"))) == want


def test_logit_limits(spark):
    assert math.isclose(one(spark, numeric.logit_percent(F.lit(0.0))), math.log(0.05 / 99.95))
    assert math.isclose(one(spark, numeric.percent_from_logit(F.lit(1000.0))), 100 / (1 + math.exp(-30)))


def test_expected_level_guards(spark):
    vec = [0.1, 2.0, -1.0, 0.0, 0.5, 1.0]
    p = np.exp(np.array(vec) - 2) / np.exp(np.array(vec) - 2).sum()
    assert math.isclose(one(spark, arrays.expected_level(F.array(*[F.lit(v) for v in vec]))), float(p @ np.arange(6)))
    assert one(spark, arrays.expected_level(F.array(*[F.lit(v) for v in vec[:5]]))) is None
    assert one(spark, arrays.expected_level(F.array(*[F.lit(v) for v in [*vec[:5], float("nan")]]))) is None


def test_argmax_is_first_and_whole(spark):
    assert one(spark, arrays.first_argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert one(spark, arrays.first_argmax(F.array(F.lit(1.0), F.lit(None).cast("double")))) is None


def test_huber_mean(spark):
    rows = [[0.1, 0.2, 0.9], [0.5, 0.5, 0.5], [0.0, 1.0, 0.2]]
    df = spark.createDataFrame([(r,) for r in rows], "v array<double>")
    got = [r["h"] for r in arrays.with_huber_means(df, {"h": F.col("v")}).collect()]
    for g, row in zip(got, rows):
        x = np.array(row)
        med = np.median(x)
        s = 1.4826 * np.median(np.abs(x - med))
        w = np.minimum(1, 1.5 / np.maximum(np.abs(x - med) / (s if s > 1e-8 else 1), 1e-12))
        assert math.isclose(g, float((w * x).sum() / w.sum()))


def test_name_key_normalises_unicode(spark):
    df = spark.createDataFrame([("hf:Ｌlama__2\\Ｂ", "a"), ("pretrained=GPT-2", "b"), (" ", "c"), (None, "d")], "n string, k string")
    got = {r["k"]: r["x"] for r in df.select("k", keys.name_key(F.col("n")).alias("x")).collect()}
    assert got == {"a": "llama2b", "b": "gpt2", "c": "", "d": ""}


def test_poisson_draws(spark):
    df = keys.with_draws(spark.range(4000), F.col("id"), 8)
    total, square = df.agg(F.sum("w"), F.sum(F.col("w") * F.col("w"))).first()
    mean = total / 32000
    assert abs(mean - 1) < 0.03 and abs(square / 32000 - mean ** 2 - 1) < 0.06


def test_fold_is_the_digest_rule(spark):
    import hashlib

    assert one(spark, keys.hash_fold(F.lit("abc"))) == int(hashlib.sha256(b"abc").hexdigest()[:8], 16) % 5


LAW = {"E": 1.7, "A": 0.9, "alpha": 0.34, "B": 1.6, "beta": 0.28}


@pytest.mark.parametrize("q,q2,k,want", [(0.5, 0.6, 0.4, "finite"), (0.0, 1.0, 50.0, "unattainable")])
def test_equivalent_size(spark, q, q2, k, want):
    status, size = laws.equivalent_size(LAW, F.lit(5.0), F.lit(40.0), F.lit(q), F.lit(q2), k)
    got = spark.range(1).select(status, size).first()
    assert got[0] == want and (got[1] is None) == (want != "finite")
    if got[1]:
        loss = lambda n, q: one(spark, laws.quality_loss("reducible_linear", LAW, F.lit(n), F.lit(40.0), F.lit(q), k))
        assert math.isclose(loss(got[1], q), loss(5.0, q2), rel_tol=1e-9)


def test_texts_are_counted_in_one_pass(spark):
    """Counts of odd texts equal those of Python strings, and no pattern walks the text once per signal."""
    texts = ["", None, " ", "a  b a\n\na  b a", "Ünï — x\u00a0y,;:.!?", "\x00A\x000 #*=<>@/\n", "AEIOU xyz. Ok!?\r\n", "\n" * 5, "😀 😀,9"]
    df = text.text_signals(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    assert "regexp_replace" not in df._jdf.queryExecution().optimizedPlan().toString()
    for row in df.orderBy("id").collect():
        t = row.text
        if t is None:
            assert all(row[n] is None for n in ["word_count", "sentence_count", *text.SIGNALS])
            continue
        words, lines, n = t.split(" "), t.split("\n"), max(len(t), 1)
        share = {k: sum(c in chars for c in t) for k, chars in text.CLASSES.items()}
        assert (row.word_count, row.sentence_count) == (len(words), share["stops"])
        assert row.unique_share == len(set(words)) / len(words) and row.mean_word_length == (len(t) - (len(words) - 1)) / len(words)
        assert row.vowel_share == (share["vowels"] / share["letters"] if share["letters"] else None)
        assert row.sentence_rate == share["stops"] / len(words) and row.line_rate == len(lines) / len(words)
        assert row.repeat_line_share == 1 - len(set(lines)) / len(lines)
        for name in ("letter", "comma", "upper", "digit", "symbol", "punct"):
            assert row[name + "_share"] == share[name + "s"] / n
