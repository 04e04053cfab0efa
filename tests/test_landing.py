"""Raw signal files with headers in any order."""

import pytest

from pulseframe.sources import landing


def test_columns_follow_each_header(spark, tmp_path):
    names = list(landing.REQUIRED_COLUMNS)
    mixed = ["extra", *reversed(names)]
    row = dict(zip(names, ("reddit", "post", "a", "x", "2024-01-01", "1", "p", "", "m")))
    for source in ("reddit", "youtube"):
        (tmp_path / source / "deep").mkdir(parents=True)
    (tmp_path / "reddit" / "one.csv").write_text(",".join(names) + "\n" + ",".join(row.values()) + "\n")
    second = row | {"id": "b", "extra": "no", "text": '"two ""lines"",\nhere"'}
    (tmp_path / "reddit" / "deep" / "two.csv").write_text("\ufeff" + ",".join(f'"{c}"' for c in mixed) + "\r\n" + ",".join(second[c] for c in mixed) + "\r\n")
    (tmp_path / "reddit" / "short.csv").write_text("id,text\nc,lost\n")
    (tmp_path / "reddit" / "empty.csv").write_text("")
    (tmp_path / "youtube" / "header only.csv").write_text(",".join(names) + "\n")
    got = {r.id: r for r in landing.load_raw_signals(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a", "b"]
    assert (got["a"].text, got["a"].parent_id, got["a"].metadata) == ("x", None, "m")
    assert (got["b"].text, got["b"].source, got["b"].engagement) == ('two "lines",\nhere', "reddit", "1")


def test_no_usable_file_is_an_error(spark, tmp_path):
    for source in ("reddit", "youtube"):
        (tmp_path / source).mkdir()
        (tmp_path / source / "other.csv").write_text("id\n1\n")
    with pytest.raises(ValueError):
        landing.load_raw_signals(spark, str(tmp_path))
