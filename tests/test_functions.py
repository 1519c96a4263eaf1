import fnmatch
import hashlib
import random
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from codesieve.catalog import fixed_values as V
from codesieve.functions import content, paths, text

LINE_CHARS = "ab #\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u2028\u2029\xa0 "


def rows(spark, values, *columns, name="v", kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} {kind}")
    return sorted(df.select("i", *columns).collect(), key=lambda r: r.i)


def random_texts(n, seed=1, chars=LINE_CHARS, size=25):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def test_lines_and_counts(spark):
    texts = random_texts(400) + ["", "\r\n\r\n", "a\n\n b", "  "]
    got = rows(spark, texts, text.split_lines(F.col("v")).alias("lines"), text.nonblank_lines(F.col("v")).alias("loc"),
               text.strip(F.col("v")).alias("stripped"))
    for r, t in zip(got, texts):
        assert list(r.lines) == t.splitlines()
        assert r.loc == len([x for x in t.splitlines() if x.strip()])
        assert r.stripped == t.strip()


def test_snippets(spark):
    texts = random_texts(200, 2, "ab\n\r\x0c")
    got = rows(spark, texts, *[text.snippet(text.split_lines(F.col("v")), F.lit(n)).alias(f"s{n}") for n in (1, 2, 4, 9)],
               text.code_snippet(F.col("v"), F.lit(3), F.lit("p"), F.lit("python")).alias("c"))
    for r, t in zip(got, texts):
        lines = t.splitlines()
        for n in (1, 2, 4, 9):
            assert r[f"s{n}"] == "\n".join(lines[max(0, n - 3):n + 2])
        if len(lines) < 3:
            assert r.c is None
        else:
            assert [(x.line_number, x.content, x.is_target) for x in r.c.lines] == [
                (i + 1, lines[i], i == 2) for i in range(0, min(len(lines), 6))]
            assert (r.c.start_line, r.c.end_line, r.c.target_line) == (1, min(len(lines), 6), 3)


def test_highlight(spark):
    r = rows(spark, ["a<b a<b"], text.highlight(F.col("v"), F.lit("a<b")).alias("h"),
             text.highlight(F.col("v"), F.lit("")).alias("none"),
             text.highlight(F.col("v"), F.lit("a<b"), escape=True).alias("e"))[0]
    mark = f"{V.HIGHLIGHT_OPEN}a<b{V.HIGHLIGHT_CLOSE}"
    assert (r.h, r.none) == (f"{mark} {mark}", "a<b a<b")
    assert r.e == " ".join([f"{V.HIGHLIGHT_OPEN}a&lt;b{V.HIGHLIGHT_CLOSE}"] * 2)


def expected_code_lines(source, language):
    """Comment rules restated: a brute-force count over the lines."""
    n, inside = 0, False
    for line in (x.strip() for x in source.splitlines()):
        if not line:
            continue
        if language == "python":
            if line[0] == "#":
                continue
            toggles = line.count('"""') % 2 or line.count("'''") % 2
            inside ^= bool(toggles)
            n += not inside and line not in ('"""', "'''")
        elif language in V.SLASH_COMMENT_LANGUAGES:
            if line.startswith("//"):
                continue
            closed = "*/" in line
            inside = not closed and (inside or "/*" in line)
            n += not closed and not inside
        elif language == "shell":
            n += line[0] != "#"
        else:
            n += 1
    return n


def test_code_lines(spark):
    pieces = ['"""', "'''", "# c", "//", "/*", "*/", "x = 1", "\n", "\n", " "]
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 30))) for _ in range(250)]
    for language in ("python", "java", "shell", "ruby"):
        got = rows(spark, texts, text.code_lines(F.col("v"), F.lit(language)).alias("n"))
        assert [r.n for r in got] == [expected_code_lines(t, language) for t in texts], language


def test_hash_lines_positions(spark):
    r = rows(spark, ["ab\ncé\n"], *[text.content_hash(F.col("v"), a).alias(a) for a in ("md5", "sha1", "sha256", "sha512", "x")],
             text.text_line(F.col("v"), F.lit(2)).alias("l2"), text.text_line(F.col("v"), F.lit(9)).alias("l9"),
             text.text_line(F.col("v"), F.lit(0)).alias("l0"),
             text.text_line_range(F.col("v"), F.lit(0), F.lit(2)).alias("range"),
             text.line_of(F.col("v"), F.lit(4)).alias("line"), text.column_of(F.col("v"), F.lit(4)).alias("col"))[0]
    for a in ("md5", "sha1", "sha256", "sha512"):
        assert r[a] == hashlib.new(a, "ab\ncé\n".encode()).hexdigest()
    assert r.x is None
    assert (r.l2, r.l9, r.l0, r.range, r.line, r.col) == ("cé", None, None, ["ab", "cé"], 2, 1)


def test_severity_and_category(spark):
    r = rows(spark, ["A03: Injection "], text.category_code(F.col("v")).alias("code"),
             text.severity_score(F.lit("CRITICAL")).alias("c"), text.severity_score(F.lit("odd")).alias("o"),
             text.category_title(F.lit("GEN"), F.lit("General")).alias("g"))[0]
    assert (r.code, r.c, r.o, r.g) == ("A03", 4, 1, "General")


def test_paths(spark):
    names = ["a.py", "x/A.PY", "b.tar.gz", ".hidden", "name.", "x/.git/y", "noext", "a b.PyW", "é.js", "d/e.f/g"]
    got = rows(spark, names, paths.base_name(F.col("v")).alias("name"), paths.extension(F.col("v")).alias("ext"),
               paths.file_language(F.col("v")).alias("lang"), paths.analyzer_language(F.col("v")).alias("analyzer"))
    for r, n in zip(got, names):
        path = PurePosixPath(n)
        last = path.name.rfind(".")
        suffix = path.name[last:].lower() if 0 < last < len(path.name) - 1 else ""
        assert (r.name, r.ext) == (path.name, suffix)
        assert r.lang == V.EXTENSION_LANGUAGES.get(suffix)
        assert r.analyzer == ("python" if suffix in (".py", ".pyw") else None)


def test_globs_equal_fnmatch(spark):
    globs = V.DEFAULT_OPTIONS["exclusions"]["patterns"] + V.DEFAULT_OPTIONS["exclusions"]["test_patterns"] + [
        "a[bc]d?.py", "[!x]*.txt", "*.p[y", "we+ird(1)|x.py", "a\nb*"]
    names = ["a.pyc", "x/a.pyc", "tests/a/b.py", "/abs/tests/a.py", "src/test_a.py", "a_test.py", "venv/lib/m.py", "venv",
             ".git/x", "abd1.py", "acdx.py", "y.txt", "x.txt", "q.p[y", "we+ird(1)|x.py", "a\nbc", "build/x", "mybuild/x"]
    for glob in globs:
        got = rows(spark, names, paths.matches_globs(F.col("v"), [glob]).alias("m"))
        want = [fnmatch.fnmatchcase(n, glob) or fnmatch.fnmatchcase(n.rsplit("/", 1)[-1], glob) for n in names]
        assert [r.m for r in got] == want, glob
    got = rows(spark, names, paths.matches_globs(F.col("v"), globs).alias("m"))
    assert [r.m for r in got] == [any(fnmatch.fnmatchcase(x, g) for g in globs for x in (n, n.rsplit("/", 1)[-1]))
                                  for n in names]


def test_pruned_directories(spark):
    names = ["venv/a.py", "x/venv/b/c.py", "venv.py", "x/y.py", "r1/q/z.py"]
    got = rows(spark, names, paths.in_pruned_directory(F.col("v"), ["venv", "r?/q"]).alias("p"),
               paths.ancestors(F.col("v")).alias("up"))
    assert [r.p for r in got] == [True, True, False, False, True]
    assert got[1].up == ["x", "x/venv", "x/venv/b"] and got[2].up == []


def test_safe_paths(spark):
    names = ["a/b", "../x", "a/../../srv/b", "/srv/./c//d", "/srvx", "..", "/srv"]
    got = rows(spark, names, paths.normalize_path(F.col("v"), "/srv").alias("n"),
               paths.is_safe_path(F.col("v"), "/srv", "/srv").alias("s"))
    assert [(r.n, r.s) for r in got] == [
        ("/srv/a/b", True), ("/x", False), ("/srv/b", True), ("/srv/c/d", True), ("/srvx", False), ("/", False), ("/srv", True)]


BYTES = [b"", b"abc\r\nd\re", "é\r\n".encode(), b"\xff\xfea\x00b\x00", b"caf\xe9\r\n", b"a\x00b", b"\xc3", b"\xed\xa0\x80x",
         b"\xc0\x80", b"\xf4\x90\x80\x80", "\ufeffx".encode(), bytes(range(128, 256)), b"\xe9" * 10 + b"a" * 100]


def python_decode(raw):
    try:
        return raw.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
    except UnicodeDecodeError:
        pass
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff") and len(raw) % 2 == 0:
        return raw.decode("utf-16")
    return raw.decode("latin-1")


def test_decoding(spark):
    rnd = random.Random(9)
    pool = [b"a", b"\xc3\xa9", b"\xe9", b"\xe2\x82\xac", b"\xf0\x9f\x98\x80", b"\xe2\x82", b"\r\n", b"\x80", b"\xf0\x9f"]
    values = [bytearray(b) for b in BYTES + [b"".join(rnd.choice(pool) for _ in range(rnd.randint(0, 8))) for _ in range(300)]]
    got = rows(spark, values, content.decode_text(F.col("v")).alias("t"),
               content.decode_text(F.col("v"), "utf-8").alias("u"), content.decode_text(F.col("v"), "ascii").alias("a"),
               content.decode_text(F.col("v"), max_size=3).alias("m"), kind="binary")
    for r, v in zip(got, values):
        raw = bytes(v)
        unix = lambda s: s.replace("\r\n", "\n").replace("\r", "\n")
        assert r.t == python_decode(raw), raw
        assert r.u == unix(raw.decode("utf-8", "replace")), raw
        assert r.a == unix(raw.decode("ascii", "replace")), raw
        assert r.m == (python_decode(raw) if len(raw) <= 3 else None)


@pytest.mark.parametrize("name", ["x.py", "x.zip", "x.unknown", "Makefile"])
def test_text_detection(spark, name):
    values = [bytearray(b) for b in BYTES]
    got = rows(spark, values, content.is_text(F.lit(name), F.col("v"), F.length("v")).alias("t"),
               content.detect_encoding(F.col("v")).alias("e"), kind="binary")
    for r, raw in zip(got, BYTES):
        try:
            valid = raw.decode("utf-8") is not None
        except UnicodeDecodeError:
            valid = False
        printable = sum(32 <= b <= 126 or b in (9, 10, 13) for b in raw)
        by_content = not raw or (b"\x00" not in raw and (valid or printable / len(raw) > 0.75))
        assert r.t == {"x.py": True, "x.zip": False}.get(name, by_content), raw
        if raw and raw.isascii():
            assert r.e == "ascii"
