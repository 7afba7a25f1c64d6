import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from stowage import jsonpath
from stowage import jsonvalue as J

values = st.recursive(st.none() | st.booleans() | st.integers(-(10**30), 10**30) | st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\0")), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(alphabet="abcé", max_size=3), x, max_size=4), max_leaves=12)


@given(values)
def test_canonical_text_is_stable_and_the_same_value(value):
    text = J.canonical(json.dumps(value))
    assert json.loads(text) == value
    assert J.canonical(text) == text


@pytest.mark.parametrize(
    ("text", "canonical"),
    [('{"bb":1,"a":2,"bb":3}', '{"a": 2, "bb": 3}'), ("1.00", "1.00"), ("1e2", "100"), ("-0.0", "0.0"), ('"\\u00e9\\n"', '"é\\n"'), ("123456789012345678901234567890.10", "123456789012345678901234567890.10"), ('{"a":[]}', '{"a": []}')],
)
def test_canonical(text, canonical):
    assert J.canonical(text) == canonical


@pytest.mark.parametrize("text", ["", "{", "NaN", "Infinity", '"\\u0000"', '"\\ud800"', "01", "{'a': 1}", '"\n"', "1e200000", "[1,]", "[" * 100000])
def test_malformed(text):
    with pytest.raises(J.JsonError):
        J.parse(text)


def test_equality_ignores_order_and_scale():
    key = lambda t: J.equality_key(J.parse(t))
    assert key('{"a": 1.0, "b": [1e1]}') == key('{"b": [10.00], "a": 1}')
    assert key("1") != key('"1"') and key("100") == key("1e2") != key("10")
    assert key("true") != key("1")


def test_accessors():
    v = J.parse('{"a": [1, null, "x"], "n": null, "o": {"k": "v"}}')
    assert J.as_json(J.field(v, "n")) == "null" and J.as_text(J.field(v, "n")) is None
    assert J.as_json(J.field(v, "zz")) is None and J.as_text(J.element(v["a"], -1)) == "x"
    assert J.as_text(J.at_path(v, ["a", "0"])) == "1" and J.as_json(J.at_path(v, [])) == J.dump(v)
    assert J.as_json(J.at_path(v, ["a", "x"])) is None and J.as_json(J.at_path(v, ["a", "3"])) is None
    assert J.has(v, "a") and not J.has(v, "k") and J.has(v["a"], "x") and J.has("x", "x")


@pytest.mark.parametrize(
    ("a", "b", "answer"),
    [('{"a": 1, "b": 2}', '{"a": 1.0}', True), ("[1, 2, [3, 4]]", "[[3]]", True), ('["a", "b"]', '"a"', True), ('"a"', '["a"]', False), ("[1, 2]", "[1, 1]", True), ('{"a": {"b": 1}}', '{"a": {}}', True), ("[]", "{}", False), ("[[1]]", "1", False), ("1", "true", False), ("[true]", "1", False)],
)
def test_containment(a, b, answer):
    assert J.contains(J.parse(a), J.parse(b)) is answer


DOC = '{"a": [{"p": 5, "s": "abc"}, {"p": 10}], "x": null, "n": {"k": 3, "m": "Abc"}}'


@pytest.mark.parametrize(
    ("path", "exists", "match"),
    [
        ("$.a[*].p ? (@ > 7)", True, None), ("$.a.p > 7", True, True), ("$.zz", False, None), ("strict $.zz", None, None), ("$.n.k == 3", True, True), ("$.n.k + 1 == 4 && !($.x != null)", True, True),
        ('$.a[0].s starts with "ab"', True, True), ('$.n.m like_regex "^abc" flag "i"', True, True), ("exists($.a[5])", True, False), ("$.a[last].p == 10", True, True), ("$.a[0 to 1].p", True, None),
        ("$.a.size() == 2", True, True), ('$.** ? (@ == "Abc")', True, None), ("$.n.keyvalue().key", True, None), ('$.n.m > 1', True, None), ("($.n.m > 1) is unknown", True, True), ("$.n.k / 0 == 1", True, None),
        ('$."n"."k"', True, None), ("$.n.* ? (@ < 4)", True, None), ("-$.n.k < 0", True, True),
    ],
)
def test_jsonpath(path, exists, match):
    value = J.parse(DOC)
    assert jsonpath.exists(value, path) is exists
    assert jsonpath.match(value, path) is match


@pytest.mark.parametrize("path", ["", "a.b", "$.", "$[", "$ ? (", "$.a ==", "$ $"])
def test_bad_paths(path):
    with pytest.raises(jsonpath.PathError):
        jsonpath.exists({}, path)
