"""Identifiers written in groups of digits, and contexts counted over all documents."""

import pytest

from tests.llm.test_pii import checked, letters

KNOWN = [(k, f"Please dial number +1 202 555 0{100 + k} soon {letters(k)}") for k in range(12)]
KNOWN += [(20 + k, f"take card number 4111 1111 1111 1111 {letters(k)}") for k in range(3)]
KNOWN += [(40 + k, f"the server address 10.0.0.{k} is up {letters(k)}") for k in range(12)]
UNSEEN = {
    100: ("Please dial number (555) 123-4567. It rings", "phone:19:33"),
    101: ("Please dial number 0171 555 0199, it rings", "phone:19:32"),
    102: ('Please dial number "(0171 555 0199)" now', "phone:21:34"),
    103: ("Please dial number (2025550199) now", "phone:20:30"),
    104: ("Please dial number 202-555-0199 2nd floor", "phone:19:31"),
    105: ("the server address 10:0:0:1 is down", "ip:19:27"),
    106: ("the code 0171 555 0199 means nothing", ""),
    107: ("Please dial number 0171 55 now", ""),
}


def test_identifiers_in_groups(spark):
    spans = checked(spark, KNOWN + [(k, t) for k, (t, _) in UNSEEN.items()])
    assert {k: spans[k] for k in UNSEEN} == {k: s for k, (_, s) in UNSEEN.items()}


def test_cards_in_groups(spark):
    cards = ["4111 1111 1111 1111", "5500 0055 5555 5559", "4012 8888 8888 1881"]
    known = [(k, f"take card number {c} {letters(k)}") for k, c in enumerate(cards)]
    assert checked(spark, [*known, (9, "take card number 4111 1111 1111 1112 now")])[9] == "card:17:36"


@pytest.mark.parametrize("other, found", [("and it is so", "phone:11:23"), ("please see the many names", "")])
def test_contexts_count_in_all_documents(spark, other, found):
    documents = [(k, f"please see +1 202 555 0{100 + k} {letters(k)}") for k in range(6)]
    documents += [(20 + k, f"{other} {letters(k)}") for k in range(40)] + [(90, "please see 202-555-0199 now")]
    assert checked(spark, documents)[90] == found


def test_runs_are_not_slow(spark):
    checked(spark, [(1, "(" * 30_000), (2, "12 " * 20_000), (3, "1(2)" * 10_000), (4, "1.2-3 " * 10_000 + "x"), (5, "1111111) " * 5000)])
