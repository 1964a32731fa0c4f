import re

import pytest

from tests.llm.test_llm_operators import new_texts

IBANS = ["BE68 5390 0754 7034", "AT611904300234573201", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00"]


def mod_97(text):
    p = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in p[4:] + p[:4])) % 97


@pytest.fixture(scope="module")
def found(spark):
    tails = ["", " USD", " IBAN", " 1234", " A", " AT611904300234573201", ", EUR 12"]
    pairs = [(i, t) for i in IBANS for t in tails]
    return [(i, t, n) for (i, t), n in zip(pairs, new_texts(spark, [f"pay {i}{t} now" for i, t in pairs]))]


def test_a_capital_word_after_an_iban_does_not_hide_it(found):
    for old, tail, new in found:
        m = new[4 : 4 + len(old)]
        assert m != old and m[:2] == old[:2] and mod_97(m) == 1 and re.sub("[0-9]", "0", m) == re.sub("[0-9]", "0", old), (old, tail, new)
        rest = new[4 + len(old) :]
        assert rest == f"{tail} now" if "AT61" not in tail else (rest[:3] == " AT" and rest != f"{tail} now" and mod_97(rest[1:21]) == 1)
