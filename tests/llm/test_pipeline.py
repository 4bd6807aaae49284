"""Queries of this subpackage against SQL, and the pipeline on planted cases."""

import random

import pytest
from compare import duck_rows, spark_rows

import corpus_pipeline
from quirework.llm import queries, sql


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_equals_sql(spark, data, name):
    assert spark_rows(queries.queries()[name](spark, data)) == duck_rows(sql.oracle_sql()[name], data)


def test_one_query_for_each_operator():
    assert [int(k[2:].split("_")[0]) for k in queries.queries()] == list(range(1, 14))


def prose(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice(["ka", "to", "mi", "re", "sol"]) for _ in range(rng.randint(2, 4))) for _ in range(n)]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rng = random.Random(11)
    docs, labels, kinds = [], [], {}

    def add(i, text, kind, label=None):
        docs.append((i, text, "en", f"s{i % 3}", len(text or "")))
        kinds.setdefault(kind, []).append(i)
        if label is not None:
            labels.append((i, 1, label))

    item = " ".join(prose(rng, 30))
    for i in range(150):
        add(i, " ".join(prose(rng, 60)), "clean", 0)
    for i in range(150, 210):
        words = prose(rng, 50)
        for _ in range(6):
            words[rng.randrange(50)] = rng.choice(["idiot", "moron", "scum"])
        add(i, " ".join(words), "toxic", 1)
    base = prose(rng, 80)
    for i in range(300, 320):
        own = list(base)
        own[rng.randrange(80)] = "changed"
        add(i, " ".join(own), "near")
    for i in range(400, 405):
        add(i, docs[3][1], "copy")
    for i in range(500, 506):
        add(i, " ".join([*prose(rng, 40), item.upper().replace(" ", "  "), *prose(rng, 10)]), "leak")
    add(600, " ".join(prose(rng, 20)) + " jo@example.com or jo (at) example (dot) com", "private")
    add(700, None, "empty")
    add(701, "", "empty")
    add(600, docs[-3][1], "again")
    docs.append((None, "no id here " + " ".join(prose(rng, 9)), None, None, None))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root), kinds


def test_stages_take_effect(spark, planted):
    root, kinds = planted
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, root).collect(), stage(spark, docs.limit(0), root).schema) if name == "mixing" else stage(spark, docs, root).cache()
        seen[name] = [r["doc_id"] for r in docs.collect()]
        assert name == "mixing" or docs.columns == columns
        if name == "pii":
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    all_ids = set(sum(kinds.values(), [])) | {None}
    assert set(seen["toxicity"]) == all_ids - set(kinds["toxic"])
    assert set(seen["near-duplicates"]) == set(seen["toxicity"]) - set(range(301, 320)) - set(kinds["copy"])
    assert len(seen["near-duplicates"]) == len(set(seen["near-duplicates"]))
    assert set(seen["decontamination"]) == set(seen["near-duplicates"]) - set(kinds["leak"])
    assert texts[600].endswith(" [EMAIL] or [EMAIL]") and texts[700] is None
    assert sorted(map(str, seen["mixing"])) == sorted(map(str, seen["pii"])) == sorted(map(str, seen["decontamination"]))


SHARED = [
    (1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (2, "quite another text of its own here"), (3, "k l m n o p q r s t u v"), (3, "k l m n o p q r s t u w"),
    (4, "same same row twice over there"), (4, "same same row twice over there"), (5, None), (5, None), (6, ""), (None, "a b c d e f g h i j"), (None, "a b c d e f g h i j"),
]


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame([(i, t, "u", "v", "w") for i, t in SHARED], "doc_id long, text string, `__component` string, row_key string, Row_Key_ string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in out.collect()]
    three = [r for r in rows if r[0] == 3]
    assert len(three) == 1 and three[0] in SHARED
    want = [SHARED[0], SHARED[2], SHARED[5], *SHARED[7:]]
    assert sorted(map(str, [r for r in rows if r[0] != 3])) == sorted(map(str, want))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table_and_odd_columns(spark, planted, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = "doc_id long, text string, lang string, source string, n_chars long, toxicity double, `__toxicity` double, size string, taken string, copies int, spans string, n_email long, key string, component_id long"
    docs = spark.createDataFrame([(1, "x y " * 200_000, "en", "s", 1, 0.9, 0.9, "a", "b", 3, "c", 4, "d", 5), (2, None, None, None, None, None, None, None, None, None, None, None, None, None)], odd)
    out = stage(spark, docs, planted[0])
    assert (name == "mixing" or out.columns == docs.columns) and out.count() == 2
    assert stage(spark, docs.limit(0), planted[0]).count() == 0


def test_run(spark, planted):
    out = corpus_pipeline.run(spark, planted[0])
    rows = out.collect()
    assert len(rows) == 150 + 1 + 1 + 2 + 1
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
