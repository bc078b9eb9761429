"""What a Python worker keeps between tasks."""

from terrane.llm import common


def test_only_the_running_operator_keeps(monkeypatch):
    monkeypatch.setattr(common, "_kept", {})
    made = []
    make = lambda k: made.append(k) or [k]
    first = common.kept_by("a", 1, make)
    assert common.kept_by("a", 1, make) is first and common.kept_by("a", 2, make) == [2] and made == [1, 2]
    common.kept_by("b")
    assert common._kept == {"b": {}} and common.kept_by("a", 1, make) is not first
