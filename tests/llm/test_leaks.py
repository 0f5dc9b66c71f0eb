import pytest

from test_mix_and_leaks import CLEAN, ITEM, leaks


@pytest.mark.parametrize("item", ["What is the capital city of France now?", "Name four rivers of Spain"])
def test_short_items_after_a_line_without_a_stop(spark, item):
    docs = [(1, f"{CLEAN}.\nQuiz night\n{item}\n{CLEAN}"), (2, f"Quiz night {item}"), (3, CLEAN), (4, "Quiz night\n" + item.replace("France", "Italy").replace("four", "five"))]
    got = leaks(spark, docs, [(7, item)])
    assert {1, 2} <= {i for i, _ in got} and (3, 7) not in got
    assert got[1, 7].n_changed == got[2, 7].n_changed == 0
    assert ((4, 7) in got) == ("France" in item)  # another name is another value, another word is not


def test_copies_in_other_letters(spark):
    item = "today Anna and Berta from Paris met Carl near Rome with David and Emma by Lake Garda for tea"
    got = leaks(spark, [(1, f"{CLEAN} {item.lower()} {CLEAN}"), (2, item.upper()), (3, CLEAN), (4, ITEM.lower())], [(1, item), (2, ITEM)])
    assert set(got) == {(1, 1), (2, 1), (4, 2)}
    assert all(r.n_windows == r.item_windows and r.n_changed == 0 for r in (got[1, 1], got[2, 1]))


def test_changed_value_does_not_hide_a_verbatim_run(spark):
    start, end = "the red house of 12 rooms by the river was sold to an old man from the south", "and of those 12 rooms 3 are now shut"
    docs = [(1, f"{CLEAN} {start} {end.replace('12', '14')} {CLEAN}"), (2, f"{start.replace('river', 'sea')} {end.replace('12', '14')}"), (3, f"{start} {end}")]
    got = leaks(spark, docs, [(1, f"{start} {end}")])
    assert set(got) == {(1, 1), (2, 1), (3, 1)}
    whole = got[3, 1].n_windows
    assert got[1, 1].n_windows == 14 and got[1, 1].n_changed == 0 and whole == got[3, 1].item_windows


def test_runs_are_judged_on_their_own(spark):
    """One run has other numbers throughout; a word of the item between the runs is changed, and a number differs after it."""
    item = "a box of 12 apples weighs 3 kg and costs 5 coins while grocer then sells 12 pears for more than 7 coins"
    doc = "a box of 13 apples weighs 4 kg and costs 6 coins while baker then sells 14 pears for more than 8 coins"
    got = leaks(spark, [(1, doc)], [(1, item)])
    assert set(got) == {(1, 1)} and got[1, 1].n_changed == 5
