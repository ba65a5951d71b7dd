"""Texts of one shape share a tree; what is read from it equals what a parse of each text gives."""

import ast

import pytest

from lodestone.operators import python_code, shapes


def told(tree):
    """Nodes with lines, names and constants."""
    return [(n.__class__, getattr(n, "lineno", 0), getattr(n, "end_lineno", 0), [(f, v if not isinstance(v, list) else [x for x in v if isinstance(x, str)]) for f, v in ast.iter_fields(n) if not isinstance(v, ast.AST)]) for n in ast.walk(tree)]


def outcome(tell, text):
    try:
        return told(tell(text))
    except (SyntaxError, ValueError) as e:
        return e.__class__, str(e)


@pytest.mark.parametrize("pair", [
    ('import a1.b2, c3 as d4\nfrom .e5.f import g6\nx = "s" + \'t\'', 'import v9.w8, x7 as rb1\nfrom .if1.f import in2\nx = "{u}" + \'# "v"\''),
    ('x = f"{a1}" + f"a1"', 'x = f"{b2}" + f"b2"'),
    ('x = "a" "b"\ny = "" "c"', 'x = "d" "e"\ny = "" "f"'),
    ('x = "a" f"b{c1}"', 'x = "d" f"b{c2}"'),
    ('f"{d["k1"]} {e["v"]}"', 'f"{d["k2"]} {e["w"]}"'),
    ('x = 1.e5 + 0x1f + a1.e5', 'x = 1.e6 + 0x2f + a2.e6'),
    ('b"x1"\nr"a1"\nu"s1"', 'b"x2"\nr"a2"\nu"s2"'),
    ('# don\'t "x1"\ny1 = "z"', '# don\'t "x2"\ny2 = "w"'),
    ('"""one"""\nglobal a1, b2\nnonlocal c3', '"""two"""\nglobal a3, b4\nnonlocal c5'),
    ('"""a\nb1"""\nc1', '"""a\nb2"""\nc2'),
    ('f(a1="x", **b1)', 'f(a2="y", **b3)'),
    ('x1 = "a\\" b1" + "c"', 'x2 = "a\\" b2" + "d"'),
    ('"a"\r\nb1 = "c"\r\n', '"a\r\nb1 = "c"\r\n'),
    ('℘a1 = éb1 = "c"', '℘a2 = éb2 = "d"'),
    ('match x1:\n  case C1(a1="s", c=_):\n    pass', 'match x2:\n  case C3(a9="t", c=_):\n    pass'),
    ("def (:", "def (:"),
    ('x1"abc"', 'f2"abd"'),
    ('"\\x73lot9_0_" + "a"', '"\\x73lot9_0_" + "b"'),
])
def test_trees_of_a_shape(pair):
    trees = shapes.Trees(lambda tree: None)
    for text in (*pair, *pair, *pair[::-1]):
        assert outcome(lambda x: trees.of(x)[0], text) == outcome(ast.parse, text)
        shape, words = shapes.shape_of(text)
        it = iter(words)
        assert "".join(next(it) if x in "\x01\x02" else x for x in shape) == text


def test_files_that_differ_in_words_are_parsed_once(monkeypatch):
    count, parse = [], ast.parse
    monkeypatch.setattr(ast, "parse", lambda *a, **b: count.append(1) or parse(*a, **b))
    text = '"""Reads {0}."""\nimport lib_{0}\nclass A{0}(B{0}):\n    def f(self, n=1):\n        h{0}(n)\nx = pd.read_csv("in_{0}.csv")\nt_{0} >> u_{0}\n'
    for k in range(50):
        s = python_code.structure(text.format(k))
        assert s["imports"] == [f"lib_{k}"] and s["classes"] == [{"name": f"A{k}", "bases": [f"B{k}"]}] and s["functions"][0]["calls"] == [f"h{k}"]
        assert python_code.data_flow(text.format(k))[0]["dataset"] == f"in_{k}.csv"
        assert python_code.task_order(text.format(k)) == [{"source": f"t_{k}", "target": f"u_{k}", "start": 7, "end": 7}]
    assert len(count) <= 3


def test_texts_without_common_shapes_are_not_kept(monkeypatch):
    monkeypatch.setattr(shapes, "TRIED", 8)
    trees = shapes.Trees(lambda tree: None)
    for k in range(100):
        trees.of("x\n" * (k + 1))
    assert trees.left and len(trees.known) == 8
    monkeypatch.setattr(shapes, "KEPT", 2)
    trees.of("y")
    assert len(trees.known) <= 8


def test_bodies_of_a_shape_are_walked_once(monkeypatch):
    walks = []

    class Counted(python_code.Found):
        def __init__(self, roots):
            walks.append(1)
            super().__init__(roots)

    monkeypatch.setattr(python_code, "Found", Counted)
    for k in range(20):
        assert python_code.structure(f"@d{k}\ndef walked(a{k}):\n    b{k}(c{k})\n")["functions"][0]["calls"] == [f"b{k}"]
    assert len(walks) <= 4


def test_texts_of_a_shape_in_use_are_matched_as_a_whole(monkeypatch):
    asked, shape_of = [], shapes.shape_of
    monkeypatch.setattr(shapes, "shape_of", lambda text: asked.append(text) or shape_of(text))
    trees = shapes.Trees(lambda tree: None)
    text = 'import a{0}, b{0}.c{0}\nx = "{1}" + \'t{0}\'\nclass A{0}(B{0}): pass\n'
    for k in range(50):
        made = text.format(k, ("s", "it's", "# {", "é")[k % 4])
        assert outcome(lambda x: trees.of(x)[0], made) == outcome(ast.parse, made)
    assert len(asked) <= 3
    for other in ('"q"', '"\\""', '""', "f'{a1}'", 'r"s"', '"s" "t"', '"s', "'s'"):  # none has the shape, though as many lines
        made = text.format(1, "s").replace('"s"', other)
        assert outcome(lambda x: trees.of(x)[0], made) == outcome(ast.parse, made)
    assert len(asked) >= 10


def test_a_shape_that_is_left_out_is_not_matched(monkeypatch):
    monkeypatch.setattr(shapes, "KEPT", 1)
    trees = shapes.Trees(lambda tree: None)
    for _ in range(2):
        for text in ("a1\n", "a1\n", "a1\n", "b1 + c1\n", "b1 + c1\n", "b1 + c1\n"):
            assert outcome(lambda x: trees.of(x)[0], text) == outcome(ast.parse, text)
            assert {id(x) for x in trees.last.values()} <= {id(x) for x in trees.known.values()}


def test_what_texts_of_a_shape_share_is_found_once(monkeypatch):
    asked, complexity_of = [], python_code.complexity_of
    monkeypatch.setattr(python_code, "complexity_of", lambda nodes: asked.append(1) or complexity_of(nodes))
    text = "class One{0}(a.B{0}):\n    def f{0}(self): pass\n    class Two{0}:\n        def g(self): pass\nif x{0}:\n    def h{0}(): pass\nelif y:\n    for i in z: pass\n"
    for k in range(20):
        s = python_code.structure(text.format(k), calls=False)
        assert s["complexity"] == 3 and s["classes"] == [{"name": f"One{k}", "bases": [f"a.B{k}"]}, {"name": f"Two{k}", "bases": []}]
        assert [f["qualified"] for f in s["functions"]] == [f"One{k}.f{k}", f"Two{k}.g", f"h{k}"]
    assert len(asked) <= 3
