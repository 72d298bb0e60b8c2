from tests.oracle import same
from waymark.llm import queries, registry


def test_sources_with_control_characters_stay(spark, tmp_path):
    names = [f"s{chr(c)}" for c in (*range(1, 32), 127)] + ['q"\\/', "é", "", None]
    rows = [(i, f"some words {i}", names[i % len(names)]) for i in range(5 * len(names))]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/parts")
    spark.read.parquet(f"{tmp_path}/parts").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_mix(spark, str(tmp_path))
    assert got.count() == len(rows) and got.where("source_size is null or target is null").count() == 0
    (part,) = (tmp_path / "documents.parquet").glob("*.parquet")
    (tmp_path / "one").mkdir()
    part.rename(tmp_path / "one" / "documents.parquet")
    same(queries.op4_mix(spark, f"{tmp_path}/one"), registry.oracle_sql()["op4_mix"], f"{tmp_path}/one")
