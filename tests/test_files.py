"""Files of several lines are read as wholes."""

from pyspark.sql.types import StructType

from marlstone.sources import files


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_json_files_of_several_lines(spark, tmp_path):
    put(tmp_path, "a/x.json", '[\n  {"k": 1, "v": "one\\ntwo"},\n  {"k": 2}\n]\n')
    put(tmp_path, "b/y.json", '{\n"k": 3\n}')
    rows = files.json_arrays(spark, str(tmp_path), StructType.fromDDL("k long, v string")).collect()
    assert sorted((r.k, r.v, r._index) for r in rows if r._bad is None) == [(1, "one\ntwo", 0), (2, None, 1)]
    assert [r._bad for r in rows if r._bad is not None] == ['{\n"k": 3\n}']


def test_pages_of_several_lines(spark, tmp_path):
    """The id is what the page says within its first 2,000 characters, else its file's name; or the other way round."""
    put(tmp_path, "1.html", "<html>\n<a href='/detail/77/'>\n</html>")
    put(tmp_path, "2.html", "<html>\nnone\n</html>")
    put(tmp_path, "3.html", "x\n" * 1500 + "<a href='/detail/88/'>")
    put(tmp_path, "name.html", "/detail/5/")
    ids = lambda **more: {r.path.rsplit("/", 1)[1]: (r.id, r.html.count("\n")) for r in files.html_cache(spark, str(tmp_path), **more).collect()}
    assert ids() == {"1.html": ("77", 2), "2.html": ("2", 2), "3.html": ("3", 1500), "name.html": ("5", 0)}
    assert ids(name_first=True) == {"1.html": ("1", 2), "2.html": ("2", 2), "3.html": ("3", 1500), "name.html": ("5", 0)}
