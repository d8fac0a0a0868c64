"""Tags of every version and coding, built by hand."""

import pytest

from cantabile.sources.tags import read_tagged, read_tags, with_tags


def seven(n):
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def tag(version, frames, extended=b"", flags=0):
    body = extended
    for name, content in frames:
        size = len(content)
        body += name.encode() + (size.to_bytes(3, "big") if version == 2 else (seven(size) if version == 4 else size.to_bytes(4, "big")) + b"\0\0") + content
    return b"ID3" + bytes([version, 0, flags]) + seven(len(body)) + body


def old(title=b"", artist=b"", album=b""):
    return b"TAG" + title.ljust(30, b"\0") + artist.ljust(30, b"\0") + album.ljust(30, b"\0") + b"\0" * 35


@pytest.mark.parametrize("version", [2, 3, 4])
@pytest.mark.parametrize(
    ("coded", "want"),
    [
        (b"\0 Plain \0more", "Plain"),
        (b"\0" + "Café – €".encode("cp1252"), "Café – €"),
        (b"\0" + "Ёлка и снег".encode("cp1251"), "Ёлка и снег"),
        (b"\0" + "А long english title with one".encode("cp1251"), "À long english title with one"),
        (b"\0" + "Да©".encode("cp1251"), "Да┩"),
        (b"\1\xff\xfe" + "Ночь ♪".encode("utf-16-le"), "Ночь ♪"),
        (b"\1\xfe\xff" + "Ночь".encode("utf-16-be"), "Ночь"),
        (b"\2" + "日本".encode("utf-16-be"), "日本"),
        (b"\3" + ("x" * 300 + "é").encode(), "x" * 300 + "é"),
        (b"\3\0\0  \0second", "second"),
        (b"\3", ""),
        (b"\3\xffok", "�ok"),
    ],
)
def test_versions_and_codings(version, coded, want):
    title, artist = ("TT2", "TP1") if version == 2 else ("TIT2", "TPE1")
    data = tag(version, [("XYZ" if version == 2 else "COMM", b"\0skip"), (title, coded), (artist, b"\3A")]) + b"\0" * 50
    assert read_tags(data) == {"title": want, "artist": "A", "album": ""}


def test_extended_headers_and_sizes():
    frames = [("TIT2", b"\3a"), ("TALB", b"\3" + b"b" * 200)]
    assert read_tags(tag(3, frames, b"\0\0\0\6" + b"\0" * 6, 0x40))["album"] == "b" * 200
    assert read_tags(tag(4, frames, seven(2) + b"\0" * 2, 0x40)) == {"title": "a", "artist": "", "album": "b" * 200}


def test_broken_tags_give_what_stands_before_the_break():
    good = tag(3, [("TIT2", b"\3one"), ("TPE1", b"\3two")])
    assert read_tags(good[:-1]) == {"title": "one", "artist": "", "album": ""}
    for n in range(len(good)):
        read_tags(good[:n])
    assert read_tags(b"ID3\3\0\0" + seven(20) + b"TIT2\xff\xff\xff\xff\0\0abcdefghij")["title"] == ""
    assert read_tags(b"ID3\3\0\0" + seven(20) + b"tit2\0\0\0\2\0\0\3aefghijkl")["title"] == ""
    assert read_tags(None) == read_tags(b"") == read_tags(b"RIFF" * 90) == {"title": "", "artist": "", "album": ""}


def test_the_trailing_tag_fills_what_is_missing():
    both = tag(4, [("TIT2", b"\3new")]) + b"\0" * 200 + old(b"old", b" who ", "café".encode("latin-1"))
    assert read_tags(both) == {"title": "new", "artist": "who", "album": "café"}
    assert read_tags(old(b"t" * 30)[1:]) == {"title": "", "artist": "", "album": ""}


def test_files_and_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.mp3").write_bytes(tag(3, [("TIT2", b"\3a")]) + b"\0" * 999)
    (tmp_path / "in" / "b.mp3").write_bytes(b"\0" * 999 + old(b"b"))
    assert sorted((r.path[-5:], r.title) for r in read_tagged(spark, str(tmp_path)).collect()) == [("a.mp3", "a"), ("b.mp3", "b")]
    df = spark.createDataFrame([(1, bytearray(old(b"x")), "old"), (2, None, "old"), (2, None, "old")], "id long, content binary, title string")
    assert sorted(map(tuple, with_tags(df).select("id", "title", "artist", "album").collect())) == [(1, "x", "", ""), (2, "", "", ""), (2, "", "", "")]
    assert with_tags(df.where("false")).collect() == []
