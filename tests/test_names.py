from itertools import combinations

from hypothesis import given
from hypothesis import strategies as st

from foldsmith.functions import names
from foldsmith.operators.combine import combination_names
from foldsmith.plans.factory import FactorySpec, layout
from foldsmith.roles import Roles

# As many flags, numbers and categories as the widest input the counts are known for.
WIDE = Roles(
    key="id",
    binary=tuple(f"flag{i}" for i in range(13)),
    numeric=tuple(f"num{i}" for i in range(8)),
    categorical=tuple(f"cat{i}" for i in range(12)),
    labels=("a", "b"),
    ordinal_levels={f"cat{i}": ("low", "high") for i in range(3)},
    penalties=((("cat0", "cat8"), 0.80), (("cat8",), 0.90), (("cat0",), 0.90)),
)


def test_legacy_counts_for_thirteen_flags_and_twelve_categories():
    assert len(names.flag_pairs(13, "legacy")) == 66
    triples = names.flag_triples(13, "legacy")
    assert len(triples) == 177
    assert len({frozenset(t) for t in triples if len(set(t)) == 3}) == 101
    assert sum(1 for a, _, c in triples if a == c) == 21
    assert len(names.category_pairs(12, "legacy")) == 45
    assert len(names.odds_pairs(12, 13, "legacy")) == 210


def test_all_counts():
    assert len(names.flag_pairs(13)) == 78
    assert len(names.flag_triples(13)) == 286
    assert len(names.category_pairs(12)) == 66
    assert len(names.odds_pairs(12, 13)) == 222


def test_wide_combinations():
    made = combination_names(WIDE.binary, "legacy")
    assert len(made) == 2256
    assert sum(1 for _, kind in made if kind == "comb") == 1128


def test_wide_layout(spark):
    roles = WIDE
    whole = spark.createDataFrame([(c, 0) for c in roles.inputs], "column string, nulls bigint")
    lay = layout(roles, FactorySpec(mode="legacy"), ("N", "Y"), whole)
    assert len(lay.stat_sets) == 12 + 45 and len(lay.odds_sets) == 12 + 210
    assert len(lay.numbers) == 11 and len(lay.comb_numbers) == 100
    assert [n.count("_or_") for n in lay.comb_numbers] == [1] * 66 + [2] * 34
    names = [n for _, n, _, _ in lay.dictionary()]
    assert len(names) == len(set(names))
    n = 111
    assert sum(k.startswith("stat") for _, _, k, _ in lay.dictionary()) == 48 * n + 180 * n + 48 * n


@given(st.integers(2, 20))
def test_legacy_is_part_of_all_pairs(n):
    assert set(names.flag_pairs(n, "legacy")) <= set(combinations(range(n), 2))


def test_names_and_penalties():
    forms = {f.name: f.column("a", "b", "c") for f in names.TRIPLE_FORMS}
    assert forms["ornot_ornot"] == "a_or_notb_or_notc"
    assert forms["and_ornot"] == "a_and_b_or_notc"
    rules = WIDE.penalties
    assert names.penalty("cat0_cat8_x", rules) == 0.80
    assert names.penalty("cat8_x", rules) == 0.90
    assert names.penalty("num1", rules) == 1.0
