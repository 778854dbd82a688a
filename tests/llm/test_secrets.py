import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import secrets

WORDS = "ordinary prose about internationalisation responsibilities straightforwardness characteristically".split()


@pytest.fixture(scope="module")
def made(spark):
    draw = random.Random(2)
    hexes = lambda n: "".join(draw.choice("0123456789abcdef") for _ in range(n))
    key = lambda: "AKIA" + "".join(draw.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    rows = []
    for i in range(300):
        text = " ".join(draw.choice(WORDS) for _ in range(60))
        secret = [None, f"password={hexes(18)}", f'token = "{hexes(40)}"', key()][i % 4]
        value = secret and secret.split("=")[-1].strip(' "')
        rows.append((i, f"{text} {secret or ''} {text}", value))
    return spark.createDataFrame(rows, "doc_id long, text string, value string")


def test_findings_are_the_planted_ones(made):
    detector = secrets.train(made)
    assert detector.forest
    rows = {r.doc_id: r for r in made.collect()}
    found = {(r.doc_id, rows[r.doc_id].text[r.start:r.start + r.length]) for r in secrets.scan(made, detector).collect()}
    assert found == {(r.doc_id, r.value) for r in rows.values() if r.value}


def test_redaction_leaves_the_rest(made):
    rows = {r.doc_id: r for r in made.collect()}
    out = secrets.redact(made, secrets.train(made))
    assert out.schema == made.schema
    for r in out.collect():
        before = rows[r.doc_id]
        assert r.text == (before.text.replace(before.value, secrets.MASK) if before.value else before.text)


def test_short_and_punctuated_values_of_a_name_are_found(made):
    values = {"password=Abc12345": "Abc12345", 'pwd: "Tr0ub4dor&3"': "Tr0ub4dor&3", "'token': 'a1.b2~c3:d4!e5'": "a1.b2~c3:d4!e5",
              "passwd = x7Kp9q, then": "x7Kp9q", "api_key=9f8.3e21d-77b0": "9f8.3e21d-77b0", "secret:=qW3$rT6^": "qW3$rT6^",
              "token=ab1.0123456789abcdef0123": "ab1.0123456789abcdef0123"}
    spark = made.sparkSession
    rows = [(1000 + i, f"ordinary prose {t} about prose", v) for i, (t, v) in enumerate(values.items())]
    plain = ["password: required", "the token = response", "Secret: Nothing", "password is 12345678", "about: Abc12345"]
    rows += [(2000 + i, f"ordinary prose {t} about prose", None) for i, t in enumerate(plain)]
    docs = spark.createDataFrame(rows, made.schema)
    more = [(3000 + i, f"ordinary prose {plain[i % 3]} about prose", None) for i in range(90)]
    detector = secrets.train(made.unionByName(docs).unionByName(spark.createDataFrame(more, made.schema)))
    text = {i: t for i, t, _ in rows}
    wanted = {(i, v) for i, _, v in rows if v}
    found = lambda judge: {(r.doc_id, text[r.doc_id][r.start:r.start + r.length])
                           for r in secrets.scan(docs, judge).collect()}
    assert found(detector) == found(secrets.Detector(detector.habits, None)) == wanted
    assert wanted <= found(secrets.train(made))  # no short value among its examples


def test_rare_secrets_are_examples_whatever_the_size(spark, made):
    """Three secrets among 100,000 texts, most of them without ids, train a forest."""
    plain = spark.range(100_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"),
        F.concat(F.lit("the token: response of internationalisation no "), "id").alias("text"),
        F.lit(None).cast("string").alias("value"))
    docs = made.where("value is not null").orderBy("doc_id").limit(3).unionByName(plain)
    detector = secrets.train(docs)
    assert detector.forest
    assert {r.secret_sha256 for r in secrets.scan(docs.where("value is not null"), detector).collect()} == {
        hashlib.sha256(r.value.encode()).hexdigest() for r in docs.where("value is not null").collect()}


def test_forest_scores_as_spark_does(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    draw = random.Random(4)
    rows = [[draw.random() for _ in range(len(secrets.FEATURES))] for _ in range(400)]
    data = spark.createDataFrame([(float(r[0] + r[3] > 1), Vectors.dense(r)) for r in rows], ["label", "features"])
    model = RandomForestClassifier(numTrees=9, maxDepth=5, seed=1).fit(data)
    import numpy as np

    score = secrets.Forest(model.toDebugString).score(np.array(rows))
    votes = [sum(t.predict(Vectors.dense(r)) for t in model.trees) / 9 for r in rows[:50]]
    assert np.allclose(score[:50], votes)


def test_odd_rows_and_empty_tables(odd):
    detector = secrets.train(odd)
    assert secrets.scan(odd, detector).count() == 0
    assert sorted(map(str, secrets.redact(odd, detector).collect())) == sorted(map(str, odd.collect()))
    assert secrets.scan(odd.limit(0), secrets.train(odd.limit(0))).count() == 0
