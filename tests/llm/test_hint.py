"""The hint of the disguise search holds back no text that the search could solve."""

import random
import re

from somnotab.llm import pii

CASES = ["host 192.168.one.5 up", "call +1 four 1 5 five 5 0 one 9 9 now", "mail joe@host [ . ] com", "card 4111 1111 1111 111one"]
PARTS = ["192.168.", "+1 ", "4111 1111 1111 ", "joe@host", "joe", "5", "415 555 0199", ".com", " ", "-", ".", "com", "x", ", "]
SIGNS = ["one", "FOUR", "double five", "plus one", "cinq", "fünf", "[ . ]", "(.)", "{ dot }", " dot ", " at ", "< AT >", "punkt", "１", "а", "​", "ſieben"]


def test_known_disguises():
    for text in CASES[:3]:
        assert pii.hidden_spans(text, pii.plain_spans(text)), text


def test_hint_changes_nothing(monkeypatch):
    rng = random.Random(7)
    texts = CASES + ["".join(rng.choice(PARTS if rng.random() < 0.7 else SIGNS) for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    hinted = [pii.hidden_spans(t, pii.plain_spans(t)) for t in texts]
    monkeypatch.setattr(pii, "_HINT", re.compile(""))
    assert [pii.hidden_spans(t, pii.plain_spans(t)) for t in texts] == hinted
    assert sum(map(bool, hinted)) > 500
    assert all(pii._HINT.search(t) for t in texts if pii._REWRITE.search(t))
