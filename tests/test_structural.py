"""Hand-written sources with the matches expected by reading the rules."""

import ast
import random

import pytest

from codesieve.functions.facts import source_facts
from codesieve.functions.structural import STRUCTURAL_RULES
from codesieve.operators import scan

CASES = [
    ("x = 'SELECT '+a+' FROM t'+b", [("PY001", 1, 4)] * 2),
    ('c.execute("SELECT %s", (a,))', [("PY001", 1, 0)]),
    ('"SELECT {}".format(x)', []),
    ('c.execute(f"SELECT {x}")', []),
    ("c.execute('select {}', 'x', 'from %s')", [("PY001", 1, 0)] * 2),
    ("execute('SELECT %s')", []),
    ("subprocess.run(cmd)", [("PY002", 1, 0)]),
    ('subprocess.run(["ls"])', []),
    ("subprocess.check_call(cmd)", []),
    ("os.system('ls', shell=True)", [("PY002", 1, 0)]),
    ("os.system('ls', shell=False)", []),
    ("os.spawnv(cmd)", []),
    ("myos.system(cmd)", [("PY002", 1, 0)]),
    ("a.b.system(cmd)", []),
    ("os.system('a' - b)", []),
    ("os.system('a' % b)", [("PY002", 1, 0)]),
    ("hashlib.md5(x)", [("PY004", 1, 0)]),
    ("HASHLIB.SHA1(x)", [("PY004", 1, 0)]),
    ("hashlib.new('md5')", []),
    ("x.hashlib.md5()", []),
    ("random.choice(l)", [("PY004", 1, 0)]),
    ("random.shuffle(l)", []),
    ("a.b.eval(x)", []),
    ("eval(x)", [("PY005", 1, 0)]),
    ("yaml.load(x); yaml.safe_load(x); cPickle.load(x)", [("PY005", 1, 0), ("PY005", 1, 33)]),
    ("if True: pass", [("PY010", 1, 0)]),
    ("if 1: pass\nelif True:\n  pass", [("PY010", 2, 0)]),
    ("while True: pass", []),
    ('self.session = "x"', [("PY011", 1, 0)]),
    ("a.session = b.session = None", [("PY011", 1, 0)] * 2),
    ("session = 'x'", []),
    ("self.session: str = 'x'", []),
    ('open("a" + b)', [("PY012", 1, 0)]),
    ("open(path)", []),
    ("open(request.args.x)", [("PY012", 1, 0)]),
    ("os.path.join(a, USER_dir)", [("PY012", 1, 0)]),
    ("pathlib.Path(f'{x}')", [("PY012", 1, 0)]),
    ("x.pathlib.Path(f'{x}')", []),
    ("render(x, safe=True)", [("PY013", 1, 0)]),
    ("a().render_it(x, is_SAFE=0)", [("PY013", 1, 0)]),
    ("render(x, **safe)", []),
    ("try: pass\nexcept E as e: print(e)", [("PY014", 2, 15)]),
    ("try: pass\nexcept E as e: print(e, e)", [("PY014", 2, 15)] * 2),
    ("try: pass\nexcept E: print(e)", []),
    ("print(api_key)", [("PY015", 1, 0)]),
    ("print('api_key', x.password)", []),
    ("x = 'é' + f(1); eval(x)", [("PY005", 1, 17)]),
    ("def broken(:", []),
    ("print x", []),
    ("", []),
    ("x = '\\ud800' + y", []),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, c[0], "python") for i, c in enumerate(CASES)], "id int, text string, language string")
    found = scan.structural_scan(scan.with_facts(df), list(STRUCTURAL_RULES), ["id"]).collect()
    got = {i: [] for i in range(len(CASES))}
    for r in found:
        got[r.id].append((r.rule_id, r.line_number, r.column_number))
    for i, (source, want) in enumerate(CASES):
        assert sorted(got[i]) == sorted(want), source


def test_severity_of_variants(spark):
    df = spark.createDataFrame([("random.choice(x)\ny = 'select ' + z", "python")], "text string, language string")
    rows = scan.structural_scan(scan.with_facts(df), list(STRUCTURAL_RULES), []).collect()
    assert {(r.title, r.severity, r.confidence) for r in rows} == {
        ("Weak Random Number Generation", "medium", "high"), ("Potential SQL Injection", "critical", "medium")}


def test_other_languages_are_not_parsed(spark):
    df = spark.createDataFrame([("eval(x)", "javascript"), ("", "python"), (None, "python")], "text string, language string")
    assert [r.facts for r in scan.with_facts(df).collect()] == [None, None, None]


@pytest.mark.parametrize("source,complexity", [
    ("def f(): return a and b and c or d", 3),
    ("def f():\n  for x in y:\n    if x: pass\n  while z: pass", 4),
    ("def f():\n  try: pass\n  except A: pass\n  except B: pass", 3),
    ("def f(): return [x for x in y for z in x]", 3),
    ("def f():\n  def g():\n    if x: pass", 2),
    ("def f(): return a if b else c", 1),
])
def test_complexity(source, complexity):
    assert source_facts(source)["functions"][0]["complexity"] == complexity


def test_functions_imports():
    facts = source_facts("import a.b, c as d\nfrom . import e\nfrom .f import g\n@x.y\n@z(1)\n@(lambda q: q)\n"
                         "def h(p, /, q, *r, s=1): ...\nasync def i(): pass\n")
    assert facts["imports"] == ["a.b", "c", "f"]
    assert [(f["name"], f["args"], f["decorators"], f["has_docstring"]) for f in facts["functions"]] == [
        ("h", ["q"], ["y", "z", "unknown"], True)]


def test_deep_nesting_has_no_facts_and_no_failure():
    for source in ("(" * 5000 + ")" * 5000, "x = " + "-" * 100_000 + "1", "a" + ".b" * 20_000, "x\x00y"):
        assert source_facts(source)["parsed"] in (True, False)


def test_walk_order_is_breadth_first():
    """Facts come in the order of a breadth-first walk over the whole tree."""
    rnd = random.Random(4)
    atoms = ["f(x)", "g(a(b), c(d))", "h(k=i(j))", "[p(q) for q in r(s)]", "t(u)(v)"]
    for _ in range(50):
        source = "\n".join(f"{rnd.choice(['', 'if n: ', 'while m: '])}{rnd.choice(atoms)}" for _ in range(8))
        want = [(n.lineno, n.col_offset) for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Call)]
        assert [(c["line"], c["col"]) for c in source_facts(source)["calls"]] == want
