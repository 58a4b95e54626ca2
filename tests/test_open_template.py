"""A template that isn't closed, and ends with a backslash."""

from lakesift.operators.scripts import declarations


def test_open_template_ends_with_a_backslash():
    assert list(declarations("`\\")) == []
    assert [kind for _, kind in declarations("class A {}\nlet x = `a\\")] == ["type"]
