from keyfold.features import catalog as C
from keyfold.features.spec import Feature, by_key_set

import pytest


def test_family_sizes():
    assert [len(x) for x in (C.BASE, C.PART2, C.PART3, C.SPANS, C.TRIPLES, C.PAIR_SPANS, C.PAIR_UNIQUES)] == [
        11, 20, 67, 11, 54, 54, 54]
    assert len(C.STD_BY_KEY) == 16 and len(C.STD_BY_ROUNDED_KEY) == 8


def test_key_sets_are_shared():
    everything = C.BASE + C.PART2 + C.PART3 + C.SPANS + C.STAGE5
    sets = by_key_set(everything)
    assert len(sets) == 146
    assert sum("user_id" in s for s in sets) == 37
    assert len(by_key_set(C.PAIR_UNIQUES + C.PAIR_SPANS)) == 21


def test_names_are_unique_within_a_stage():
    for features in (C.BASE + C.PART2, C.PART3 + C.SPANS, C.STAGE5):
        names = [f.name for f in features]
        assert len(names) == len(set(names))


def test_irregular_names_are_kept():
    names = {f.name for f in C.PART2 + C.PART3 + C.PAIR_SPANS}
    assert {"region_all_categ_minmax_difff_count", "city_all_categ_minmax_diff_count_count",
            "param_1_price_image_top_1_diff", "param_2_category_name_price_diff"} <= names


def test_bad_features_are_refused():
    with pytest.raises(ValueError):
        Feature("x", ("a",), "median", "b")
    with pytest.raises(ValueError):
        Feature("x", ("a",), "distinct")
    with pytest.raises(ValueError):
        Feature("x", ())
