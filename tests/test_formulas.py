import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tempora.plans import formula as P
from tempora.plans.catalog import BENCHMARK, catalog
from tempora.plans.notation import FormulaError, formula


@pytest.mark.parametrize("text,want", [
    ("x > 5", P.gt("x", 5)), ("x>=-1.5", P.Not(P.lt("x", -1.5))), ("x <= 2", P.Not(P.gt("x", 2))), ("x == 3", P.eq("x", 3)),
    ("x > $high", P.gt_var("x", "high")), ("x < low", P.lt_var("x", "low")), ("true", P.TRUE), ("false", P.FALSE),
    ("G[0,2](x>3)", P.always(0, 2, P.gt("x", 3))), ("globally[0, 2](x>3)", P.always(0, 2, P.gt("x", 3))), ("G [0,2] x > 3", P.always(0, 2, P.gt("x", 3))),
    ("F[0.5,2](x>3)", P.eventually(0.5, 2, P.gt("x", 3))), ("eventually[1,2](!(x>3))", P.eventually(1, 2, ~P.gt("x", 3))),
    ("x>1 U[0,4] y<2", P.until(0, 4, P.gt("x", 1), P.lt("y", 2))), ("x>1 until [0,4] y<2", P.until(0, 4, P.gt("x", 1), P.lt("y", 2))),
    ("x>1 && y>2 || z>3", (P.gt("x", 1) & P.gt("y", 2)) | P.gt("z", 3)), ("x>1 and y>2 or z>3", (P.gt("x", 1) & P.gt("y", 2)) | P.gt("z", 3)),
    ("x>1 -> y>1 -> z>1", P.gt("x", 1) >> (P.gt("y", 1) >> P.gt("z", 1))), ("not x>1 and y>1", ~P.gt("x", 1) & P.gt("y", 1)),
    ("x>1 U[0,1] y>1 U[0,2] z>1", P.until(0, 2, P.until(0, 1, P.gt("x", 1), P.gt("y", 1)), P.gt("z", 1))),
])
def test_reading(text, want):
    assert formula(text) == want


@pytest.mark.parametrize("text", ["", "x", "x >", "G[2,1](x>1)", "G[-1,1](x>1)", "G[0,1(x>1)", "(x>1", "x>1)", "x>1 &&", "x > $", "x ? 1", "> 3", "F[0](x>1)"])
def test_not_formulas(text):
    with pytest.raises(FormulaError, match="Parse error at position"):
        formula(text)


def test_error_position():
    with pytest.raises(FormulaError) as e:
        formula("x > 1 && ?")
    assert e.value.position == 9


def test_display_and_tree():
    f = P.always(0, 5, P.gt("x", 1) >> P.eventually(0.5, 2, ~P.lt_var("y", "v")))
    assert str(f) == "G[0, 5]((x > 1) → (F[0.5, 2](¬(y < $v))))"
    assert f.tree().splitlines()[0] == "Globally[0,5]" and "└── Implies" in f.tree()
    assert str(P.lowered(P.gt("x", 1) >> P.lt("y", 2))) == "(¬(x > 1)) v (y < 2)"
    assert f.signals() == ["x", "y"] and f.variables() == ["v"] and f.depth() == 7_000_000


def test_bounds_are_checked():
    for bad in ((2, 1), (-1, 0)):
        with pytest.raises(ValueError):
            P.always(*bad, P.TRUE)
    with pytest.raises(ValueError):
        P.microseconds(1e-7)


def test_catalog():
    assert len(catalog()) == 21 and set(catalog([3, 19])) == {3, 19}
    assert len(list(catalog([15])[15].walk())) == 11  # shared subformulas count once
    assert BENCHMARK["phi2"].depth() == 1_100_000_000


atoms = st.builds(P.Compare, st.sampled_from("xyz"), st.sampled_from("<>"), st.integers(-9, 9).map(float))
bounds = st.tuples(st.integers(0, 5), st.integers(0, 5)).map(lambda p: (p[0], p[0] + p[1]))
formulas = st.recursive(atoms, lambda f: st.one_of(
    st.builds(P.And, f, f), st.builds(P.Or, f, f), st.builds(P.Implies, f, f), st.builds(P.Not, f),
    st.builds(lambda b, x: P.always(*b, x), bounds, f), st.builds(lambda b, x: P.eventually(*b, x), bounds, f), st.builds(lambda b, x, y: P.until(*b, x, y), bounds, f, f)), max_leaves=8)


@settings(max_examples=100, deadline=None)
@given(formulas)
def test_text_form_reads_back(f):
    text = str(f).replace("¬", "!").replace("∧", "&&").replace(" v ", " || ").replace("→", "->")
    assert formula(text) == f
