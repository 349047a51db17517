"""The DuckDB twins on the driver's data and on a table of odd rows; held-out accuracy of the trained operators."""

from __future__ import annotations

import os
import random

import pytest

from tests.compare import compare, duck
from trailscope.llm import queries

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.exists(LARGER), reason="driver data not present")


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    ok, message = compare(spark, name, SMALL, duck(SMALL))
    assert ok, message


def _documents(rng: random.Random) -> list[tuple]:
    prose = [" ".join(f"W{rng.randrange(400)}é" for _ in range(rng.randint(60, 160))) for _ in range(12)]
    near = prose[2].split(" ")
    near[-1] = "other"
    lines = ["  Shared line\t", "shared LINE", "\r", "rare"]
    texts = [*prose, prose[0], prose[0].lower(), " ".join(near), f"{prose[3]} {prose[4]}"]
    texts += [None, "", " \t\n ", "one two", "one  TWO", "x" * 900, "ab" * 500, "# * $ " * 40, "LOUD WORDS " * 60, "日本語 ²½ ǅ " * 30]
    texts += ["\n".join([lines[k % 2], lines[2], f"own {k}", lines[1], ""]) for k in range(11)]
    return [*enumerate(texts), (3, prose[3])]


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", ["op1_suffix_dedup", "op8_minhash", "op10_quality_cascade", "op13_line_dedup"])
def test_documents_match_sql(spark, tmp_path, name, empty):
    rows = [] if empty else _documents(random.Random(6))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    ok, message = compare(spark, name, str(tmp_path), duck(str(tmp_path)))
    assert ok, message


def test_conversations_match_sql(spark, tmp_path):
    rng = random.Random(7)
    texts = ["</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>> & <|im_end|>", "", None, "a\x0bb &; c", "é, ü! " * 200, "w " * 700, "short turn"]
    rows = [(c, t, "system" if t == c % 3 else rng.choice(["user", "assistant", None, "to\nol"]), rng.choice(texts)) for c in range(9) for t in range(rng.randint(1, 30))]
    rows += [(0, 0, "user", "again"), (0, None, "assistant", "no turn")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    ok, message = compare(spark, "op9_chat_format", str(tmp_path), duck(str(tmp_path)))
    assert ok, message


@needs_data
def test_held_out_languages(spark):
    truth = spark.read.parquet(f"{LARGER}/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    rows = queries.op5_language_id(spark, LARGER).where("held_out AND lang_pred <> 'und'").join(truth, "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


@needs_data
def test_held_out_toxicity(spark):
    truth = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op7_toxicity(spark, LARGER).where("held_out").join(truth, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert len(toxic) >= 10 and sum(toxic) >= 0.5 * len(toxic) and sum(clean) <= 0.02 * len(clean)
