"""Letters without a plain capital or small letter, odd blanks: the rows are those of the SQL."""

import duckdb
import pytest

import __spark_entry__ as entry


def same(spark, folder, name, **tables):
    """Rows of a query over `tables` (schema, rows), as Spark and as DuckDB have them."""
    with duckdb.connect() as c:
        for t, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        want = c.execute(entry.oracle_sql()[name])
        columns = [x[0] for x in want.description]
        got = entry.queries()[name](spark, str(folder)).select(*columns).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def talks(openings):
    rows = [(i, n, ("user", "assistant")[n % 2], x) for i, t in enumerate(openings) for n, x in enumerate((t, "other words", f"yes {t}"))]
    return {"conversations": ("conv_id long, turn long, role string, text string", rows)}


def documents(texts):
    rows = [(i * 50, t, "de", f"src{i}" if i else None, len(t or "")) for i, t in enumerate(texts)]
    return {"documents": ("doc_id long, text string, lang string, source string, n_chars long", rows)}


def test_asked_words_keep_their_letters(spark, tmp_path):
    same(spark, tmp_path, "eval_evidence", **talks(["ßuper ok", "ıssızlık a", "ﬁnd", "hello"]))


def test_codes_are_upper_case_letter_by_letter(spark, tmp_path):
    texts = ["öß one", "ßa two", "ǰab öß", "Öß and ßa", None]
    same(spark, tmp_path / "a", "name_mentions", **documents(texts))
    same(spark, tmp_path / "b", "name_codes", **documents(texts))


def test_summaries_with_odd_blanks_lines_and_letters(spark, tmp_path):
    texts = ["\n# Title one\nWe decided to go. More here.", "We decided | this\n# is no comment. End", " We decided that. ", "\tTab first. We decided it\t",
             "we chose it　", None, "", "  ", "İstanbul decided İ. DECIDEDİ", "joy+love|we decided joy + LOVE |Joy+ love|x |y "]
    same(spark, tmp_path, "summary_decode", **documents(texts))
