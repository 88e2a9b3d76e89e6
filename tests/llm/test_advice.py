"""Cases of the second review that the operators used to miss."""

from __future__ import annotations

import numpy as np

from firmledger.llm import decontaminate

QUESTION = "If the farmer Anna sells 12 apples for 3 euros each and then pays Anna 5 euros, how much money is left for the market?"


def leaks(spark, items, texts):
    asked = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = decontaminate.benchmark_leaks(docs, asked).collect()
    return {r.doc_id: r.item_ids for r in found if r.contaminated}


def test_a_conflicting_slot_ends_a_run_but_spoils_no_other_window(spark):
    texts = [
        QUESTION.replace("Anna sells", "Berta sells"),
        QUESTION.replace("12", "7").replace("for 3", "for 7"),
        QUESTION.replace("Anna sells", "Berta sells").replace("pays Anna", "pays Clara"),
        "If the farmer Berta sells apples and pays Clara in the market",
    ]
    assert set(leaks(spark, [QUESTION], texts)) == {0, 1, 2}


def test_a_run_ends_where_a_changed_value_changes_again():
    window = lambda at, *changed: (at, at + 8, at, at + 8, list(changed))
    assert decontaminate.coverage([window(k, (1, 2)) for k in range(8)], 40) == 15
    assert decontaminate.coverage([window(k, (1, 2) if k < 6 else (1, 3)) for k in range(12)], 40) == 13
    assert decontaminate.coverage([window(0, (1, 2)), window(1), window(2), window(3), window(8, (1, 3))], 40) == 15
    assert decontaminate.coverage([window(0)], 40) == 0


def test_word_for_word_copies_are_found_in_any_surrounding(spark):
    item = "Every morning the baker Anna gives her neighbour Berta fresh bread and takes home some eggs instead"
    short = "What is the name of the river that flows past this old town"
    plus, numbers, names = "What is 12 plus 30?", "3 1 4 1 5 9 2 6 5 3 5 8 9 7", "Anna, Berta, Clara, Dora"
    texts = [
        item.lower(),
        item.replace(" Anna", "\nAnna").replace(" Berta", "\r\n\tBerta"),
        item.replace(" Anna", " " * 30 + "Anna").replace("Berta", "Clara"),
        "they then asked " + short,
        f"so {plus}",
        f"digits {numbers} follow",
        f"and {names} went",
        "what is 13 plus 31",
        "nothing of it",
    ]
    found = leaks(spark, [item, short, plus, numbers, names], texts)
    assert found == {0: [0], 1: [0], 2: [0], 3: [1], 4: [2], 5: [3], 6: [4]}


def test_first_word_of_an_item_may_become_a_name(spark):
    item = "Anna buys 3 loaves and 4 eggs at the market today"
    found = leaks(spark, [item], ["here it says that " + item.replace("3", "7"), item.replace("3", "7")])
    assert found == {0: [0], 1: [0]}


def test_slots_may_change_their_number_of_tokens(spark):
    item = "Yesterday the clerk Anna paid 4 dollars for each of 500 stamps, then 78 more for the parcel that went to the town of her uncle"
    long = "the old mill by the river grinds the corn of the whole valley and the miller sells flour"
    texts = [
        item.replace("4 dollars", "2.50 dollars").replace("500", "1,200").replace("78", "82.5").replace("Anna", "Mary Ann"),
        item.replace("Anna paid", "Anna quite happily paid").replace("then 78", "and then some 82.5").replace("her uncle", "an aunt"),
        long.replace("of the whole", "of, as people say, the whole"),
        "the old mill by the river grinds the corn " + "of other things " * 30 + "the whole valley and the miller sells flour",
    ]
    assert leaks(spark, [item, long], texts) == {0: [0], 1: [0], 2: [1]}


def test_runs_of_numbers_and_names_are_one_placeholder():
    kinds = [0, 1, 1, 0, 2, 2, 2, 3, 3, 2, 1, 1]
    coded = np.array([(k + 5) * 4 + kind for k, kind in enumerate(kinds)], np.int64)
    folded, sizes, place = decontaminate.template(coded, np.array([6, 0, 6]))
    assert (folded & 3).tolist() == [0, 1, 0, 2, 2, 3, 3, 2, 1] and sizes.tolist() == [4, 0, 5]
    assert place.tolist() == [0, 1, 1, 2, 3, 3, 0, 1, 2, 3, 4, 4]
    assert folded[4] == coded[6] and folded[1] != coded[1]
    assert [len(x) for x in decontaminate.template(coded[:0], np.array([0, 0]))] == [0, 2, 0]
