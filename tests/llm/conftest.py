import random

import pytest

WORDS = "stone river light under green window paper seven ocean quiet maple orbit candle silver harbor meadow copper violet thunder garden".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


#: (id, text): what each operator must take: nulls, empty and blank texts, few words, a very long text, repeated rows.
HARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "Ünïcode ▁ 執 😀\x00 <s> <0x41>"), (6, prose(1, 30000)), (7, prose(2, 60)), (7, prose(2, 60)),
    (8, prose(2, 60)), (None, prose(2, 60)), (None, None), (9, prose(3, 40) + "\n" + prose(3, 40)), (10, "x" * 50000), (11, "a b c"), (12, "A B C"),
    (-5, prose(4, 25)),
]
#: Names that operators use for columns of their own.
CLASHES = "the_text the_key the_rest key n_words kept base_failed copy licence dice component node hub score label x mix_u mix_source mix_rate h1s first_key text_ n_chars word_chars the_lines".split()


@pytest.fixture
def documents(spark):
    def make(rows, extra=False):
        columns = "doc_id bigint, text string, lang string, source string" + "".join(f", {c} string" for c in CLASHES) * extra
        filled = [(i, t, "en", "s" + str(k % 3)) + ("?",) * len(CLASHES) * extra for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(filled, columns).repartition(3)

    return make
