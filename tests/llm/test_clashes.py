"""Pipeline stages keep extra columns whatever their names, and decide as without them."""

from pyspark.sql import functions as F

from ledgermill.llm import decontamination, mixing, near_copies

CLASHES = ["_doc", "_key", "_text_key", "_copies", "_n", "_key_here", "_times", "_rank", "_copy", "_gone", "_twice", "_DOC"]


def _with_clashes(df):
    for k, name in enumerate(CLASHES):
        df = df.withColumn(name, F.concat(F.lit(f"c{k}-"), F.col("doc_id").cast("string")))
    return df


def _rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_stages_with_clashing_columns(spark, documents):
    passage = " ".join(f"bench{k}" for k in range(12))
    base = [f"word{k} " * 30 for k in range(6)]
    rows = [(k, t) for k, t in enumerate(base)] + [(10, base[0]), (11, base[1] + " x"), (12, "before " + passage + " after"), (13, None)]
    plain = documents(rows)
    clashing = _with_clashes(plain)
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")

    kept = near_copies.keep_one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert _rows(kept, plain.columns) == _rows(near_copies.keep_one_of_each(plain), plain.columns)
    assert all(r["_gone"] == f"c9-{r['doc_id']}" for r in kept.collect())

    clean = decontamination.drop_contaminated(clashing, items)
    assert clean.columns == clashing.columns and 12 not in {r["doc_id"] for r in clean.collect()}
    assert _rows(clean, clashing.columns) == _rows(_with_clashes(decontamination.drop_contaminated(plain, items)), clashing.columns)

    mixed = mixing.take_copies(clashing, mixing.mix_sources(clashing))
    assert mixed.columns == clashing.columns
    assert _rows(mixed, plain.columns) == _rows(mixing.take_copies(plain, mixing.mix_sources(plain)), plain.columns)
    assert all(r["_copies"] == f"c3-{r['doc_id']}" for r in mixed.collect())
