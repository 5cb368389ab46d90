import pytest

from textlode.sources.yaml import YamlError, load, load_all

CASES = [
    ("a: 1\nb: [x, 'y z', \"q\\n\"]\nc: {d: e, f: [1, 2]}\n", {"a": 1, "b": ["x", "y z", "q\n"], "c": {"d": "e", "f": [1, 2]}}),
    ("- id: A\n  match:\n    regex:\n      pattern: |-\n        a{2}: #b\n         c\n      flags: i\n- id: B\n", [{"id": "A", "match": {"regex": {"pattern": "a{2}: #b\n c", "flags": "i"}}}, {"id": "B"}]),
    ("a: >\n  one\n  two\n\n  three\nb: |+\n  x\n\nc: |\n  y\n", {"a": "one two\nthree\n", "b": "x\n\n", "c": "y\n"}),
    ("base: &b {x: 1, y: 2}\nmore:\n  <<: *b\n  y: 3\n", {"base": {"x": 1, "y": 2}, "more": {"x": 1, "y": 3}}),
    ("k:\n- 1\n- 2.5\n- ~\n- true\n- 'it''s'\n- - 3\n  - x: y\n", {"k": [1, 2.5, None, True, "it's", [3, {"x": "y"}]]}),
    ("a: b # comment\nurl: http://x/y#z\ntime: 12:30\n# end\n", {"a": "b", "url": "http://x/y#z", "time": "12:30"}),
    ('"a: b": "\\u00e9\\x41"\nplain text: over\n  two lines\n', {"a: b": "éA", "plain text": "over two lines"}),
    ("x: [a,\n  b, # note\n  {c: d}]\ny: !tag z\n", {"x": ["a", "b", {"c": "d"}], "y": "z"}),
    ("", None),
    ("just text", "just text"),
]


@pytest.mark.parametrize("text,want", CASES)
def test_load(text, want):
    assert load(text) == want


def test_against_a_full_reader():
    yaml = pytest.importorskip("yaml")
    for text, _ in CASES:
        if "12:30" not in text and "!tag" not in text:
            assert load(text) == yaml.safe_load(text)


def test_documents_and_errors():
    assert load_all("--- a\n---\nb: 1\n...\n---\n- c\n") == ["a", {"b": 1}, ["c"]]
    for text in ("a: 1\na: 2", "a: *none", "a: [1, 2", "a:\n\tb: 1", "a: 1\n   b: 2", "x: " + "[" * 100 + "]" * 100, 'a: "\\q"'):
        with pytest.raises(YamlError):
            load(text)
