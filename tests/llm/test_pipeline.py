"""The pipeline, stage by stage, against brute force; and the entry point without it."""

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from test_dedup_ops import brute_lines
from test_ngram_join import brute_components

ROOT = Path(__file__).resolve().parents[2]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows that each stage was given and gave."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "out")
        stage(spark, docs, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return out


def test_columns_are_kept(stages):
    for _, before, after in stages[:-1]:
        assert list(after[0].asDict()) == list(before[0].asDict()) == COLUMNS


def test_documents_go_by_their_score(stages, spark, sf_dir):
    from findmill.llm import queries

    _, before, after = stages[0]
    predicted = {r.doc_id: r.predicted for r in queries.op7_toxicity(spark, sf_dir).collect()}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if not predicted[r.doc_id])


def test_held_out_labels(spark):
    """With some thousand labels most toxic rows go and clean ones stay."""
    from findmill.llm import queries

    folder = Path("/root/testdata/sf0.1")
    if not folder.is_dir():
        pytest.skip("no test data")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op7_toxicity(spark, str(folder)).where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_lines(stages):
    _, before, after = stages[1]
    expected = [(i, kept) for i, _, _, kept in brute_lines([(r.doc_id, r.text, None) for r in before], 40, 5)]
    assert sorted((r.doc_id, r.text) for r in after) == expected
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_copies(stages):
    _, before, after = stages[2]
    component = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(set(component.values()))


def test_mix_keeps_every_document(stages):
    _, before, after = stages[3]
    assert {tuple(r) for r in after} == {tuple(r) for r in before}


def test_ids_decode_to_the_text(stages):
    _, before, after = stages[4]
    assert len(after) == len(before) and all(r.round_trip and len(r.ids) == 4 * r.n_tokens for r in after)


def test_rows_without_id_and_repeated_rows(spark, sf_dir):
    rows = [(None, "one two three four five six"), (None, "one two three four five six"), (7, "a b c d e f g"), (7, "a b c d e f g"), (9, "a b c d e f g"), (11, None), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS source", "0L AS __slot")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0 for r in kept)) == [0, 0, 7, 11, 12]
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)
    assert corpus_pipeline.drop_lines(spark, docs, sf_dir).count() == len(rows)
    assert corpus_pipeline.encode(spark, docs.limit(0), sf_dir).count() == 0


def test_entry_point_works_without_the_operators(tmp_path):
    """The entry point imports where the folder and the pipeline are missing."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'findmill.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        f"sys.path.insert(0, {str(ROOT)!r})\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, cwd=tmp_path)
    assert done.returncode == 0 and done.stdout.split()[1] == "False", done.stderr[-500:]


def test_settled_tables_leave_no_shuffle_files(spark):
    import time

    from findmill.llm.tables import settled

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept = spark.conf.get(key)
    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(filter(lambda f: "shuffle_" in f, store.getAllFiles().mkString("\n").split("\n")))
    before = files()
    table = settled(spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(5, "k"), "settled-test")
    for _ in range(100):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert table.count() == 1000 and spark.conf.get(key) == kept
