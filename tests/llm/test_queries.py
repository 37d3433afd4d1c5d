import re
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from indexloom.llm import packing, quality_mil
from indexloom.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import least_of_groups, plain_lines
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf).toPandas(), connect(sf).execute(ORACLE_SQL[name]).fetchdf()) == []


def test_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = docs.cache()
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3]
    assert docs.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.where("start = 0").count() == sizes[-1]


def test_pipeline_stages_equal_plain(spark, sf):
    """Each stage, on what those before it left, against a plain version of its decisions."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        made.append(docs)
    raw = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in quality_mil.classify(raw, labels).collect() if r["predicted"]}
    first = {r["doc_id"]: r["text"] for r in made[0].collect()}
    assert set(first) == good and first == {r["doc_id"]: r["text"] for r in raw.collect() if r["doc_id"] in good}
    gone = plain_lines((i, t or "") for i, t in first.items())
    second = {r["doc_id"]: r["text"] for r in made[1].collect()}
    assert second == {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in first.items()}
    ids = sorted(second)
    least, _ = least_of_groups([re.sub("[A-Z]", lambda m: m[0].lower(), second[i] or "") for i in ids])
    third = made[2].toPandas()
    assert set(third["doc_id"]) == {ids[k] for k in least} and len(third) == len(least)
    con = duckdb.connect()
    con.register("documents", third)
    mixed = {r[0]: r[1] for r in con.execute("SELECT doc_id, taken // greatest(size, 1) FROM (" + ORACLE_SQL["op1_mixing"] + ") WHERE size > 0").fetchall()}
    copies = Counter(r["doc_id"] for r in made[3].collect())
    assert {i: n for i, n in copies.items() if second[i] and second[i].split()} == {i: n for i, n in mixed.items() if n}
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    pieces, rooms = defaultdict(Counter), defaultdict(list)
    for r in made[4].collect():
        pieces[r["doc_id"]][r["start"], r["length"], r["doc_tokens"]] += 1
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, n in copies.items():
        total = len(tokenizer.encode(second[i] or "", add_special_tokens=False).ids) + 1
        assert pieces[i] == {(at, min(1024, total - at), total): n for at in range(0, total, 1024)}
    for held in rooms.values():
        held.sort()
        assert [a for a, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 1024


def test_pipeline_takes_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
