import random

from typeharvest.llm import neardup


def test_one_id_with_two_texts_and_a_near_copy_of_each(frame):
    rnd = random.Random(4)
    first, second = (["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(100)] for _ in range(2))
    near = lambda words: " ".join([*words[:-2], "other", "end"])
    rows = neardup.near_duplicates(frame([(1, " ".join(first)), (1, " ".join(second)), (2, near(first)), (3, near(second))])).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 1}
