from tidemark.operators import wordcount
from tidemark.streaming import runs

from .conftest import same_rows


def test_counts_follow_the_folder(spark, tmp_path):
    source, out, state = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/state"
    source.mkdir()
    for name, text, expected in (("a.txt", "map old\nmap", [("map", 2), ("old", 1)]), ("b.txt", "map new none", [("map", 3), ("old", 1), ("new", 1), ("none", 1)])):
        (source / name).write_text(text)
        runs.run_counts(wordcount.word_counts(runs.line_stream(spark, str(source))), ["word"], "cnt", out, state)
        same_rows(runs.current_counts(spark, out, ["word"], "cnt").collect(), expected)
