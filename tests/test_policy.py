import pytest

from stowage.policy import Policy, PolicyError


@pytest.mark.parametrize(
    ("text", "policy"),
    [("(6)", Policy(6)), ("(6,1)", Policy(6, 1)), ("(9, first)", Policy(9, 7)), ("(9,'first')", Policy(9, 7)), ("(22,33554431,pending)", Policy(22, 33554431, True)), ("", None), ("(3, 0, PENDING)", Policy(3, 0, True))],
)
def test_parse(text, policy):
    assert Policy.parse(text, {"first": 7}.__getitem__) == policy


@pytest.mark.parametrize("text", ["(0)", "(23)", "(6,33554432)", "(6,1,now)", "()", "6", "(6,,pending)", "(a)", "(6,1,pending,x)"])
def test_refused(text):
    with pytest.raises(PolicyError):
        Policy.parse(text)


def test_names_need_a_registry_and_digits_are_slots():
    with pytest.raises(PolicyError):
        Policy.parse("(6,first)")
    assert Policy.parse("(6,'12')").slot == 12


def test_printed_form_reads_back():
    for p in (Policy(6), Policy(6, 1), Policy(6, 1, True), Policy(3, 0, True)):
        assert Policy.parse(str(p)) == p
    assert [str(Policy(6)), str(Policy(6, 1)), str(Policy(6, 1, True))] == ["(6)", "(6,1)", "(6,1,pending)"]


def test_metadata_round_trip():
    assert Policy.of_metadata(Policy(9, 4, True).metadata("text")) == Policy(9, 4, True)
    assert Policy.of_metadata({}) is None
