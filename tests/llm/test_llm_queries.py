"""Registered queries on the smallest tables: SQL pairs, contracts, and the pipeline's stages."""

import os

import duckdb
import pytest

from tickspark.llm import queries as Q
from tests.test_sql_pairs import rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_pair(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours, theirs = Q.queries()[name](spark, SF).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours, sorted(ours.columns)) == rows(theirs, sorted(ours.columns))


def test_native_url_plan(spark):
    plan = Q.op5_urls(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan.split("Physical Plan")[-1]


def test_language_stage_rejects_unlearnt_latin_texts(spark):
    import base64
    import random

    from tickspark.llm import language
    from tickspark.llm.common import table

    rng = random.Random(4)
    docs = table(spark, SF, "documents")
    bad = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz" + gap) for _ in range(n)) for n in (40, 3000) for gap in ("", "    ")] + [base64.b64encode(rng.randbytes(n)).decode() for n in (60, 3000)]
    bad += ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."]
    bad += ["Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek."]
    good = ["word", "Hello", "x", "Straße", "two words"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(bad + good)], "doc_id long, text string")
    kept = language.explained(rows, language.labelled_sample(docs.where(language.learnable())))
    assert {r.text for r in kept.collect()} == set(good)


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from tickspark.llm import neardup, pii
    from tickspark.llm.common import table

    docs = table(spark, SF, "documents")
    columns = docs.columns
    known = P.known_languages(spark, docs, SF).cache()
    assert known.columns == columns and known.count() == docs.count()
    single = P.one_of_each(spark, known, SF).cache()
    assert single.columns == columns and 0 < single.count() < known.count()
    assert neardup.near_duplicates(single).where("doc_id <> component_id").count() == 0
    private = P.without_personal_data(spark, single, SF).cache()
    assert private.columns == columns and private.count() == single.count()
    assert all(not pii.base_spans(r.text) for r in private.collect())
    mixed = P.mixed(spark, private, SF)
    assert mixed.columns == columns
    assert P.packed(spark, mixed, SF).count() > 0
    assert [name for name, _ in P.STAGES] == ["language", "neardup", "pii", "mixing", "packing"]
