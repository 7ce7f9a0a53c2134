"""The files of the streamed documents."""

import glob

from loquat.plans import queries


def test_files_of_a_stream_grow_with_the_table_in_number_not_in_size(spark, tmp_path):
    for n in (500, 100_000):
        spark.range(n).selectExpr("id AS doc_id", "'a' AS text").write.parquet(f"{tmp_path}/{n}/documents.parquet")
    few, many = (len(glob.glob(f"{queries.streamed(spark, f'{tmp_path}/{n}')[0]}/in/*.parquet")) for n in (500, 100_000))
    assert few == 4 and many == 10
