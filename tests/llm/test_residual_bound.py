"""What members of a star can share: extras of one component alone link nothing, and their holders move by parts."""

from __future__ import annotations

import random

from test_operators import brute_components

from weekloom.llm import minhash


def test_extras_of_one_component_are_not_counted(spark, monkeypatch):
    draw = random.Random(12)
    word = lambda: f"w{draw.randrange(10**6)}"
    base, one, two, other = ([word() for _ in range(n)] for n in (300, 8, 8, 60))
    # Near copies of one component have one of two tails, and a word of their own.
    texts = {k: " ".join([*base[:280], word(), *(one, two)[k % 2]]) for k in range(100)}
    # Outside of that component: two parts of the text that link with each other, and one that links with nothing.
    texts |= {900: " ".join(base[:232]), 901: " ".join([*base[:228], *other[:3]]), 902: " ".join([*base[:226], *other[20:]])}
    made, real = {}, minhash.materialize

    def keep(df, name):
        made[name] = real(df, name).cache()
        return made[name]

    monkeypatch.setattr(minhash, "materialize", keep)
    monkeypatch.setattr(minhash, "discard", lambda kept, *tables: kept)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {k: label for k, (_, label) in brute_components(texts).items()}
    assert {got[k] for k in range(100)} == {0} and got[901] == got[900] == 900 and got[902] == 902
    assert made["live"].where("label <> hub").count() > 50
    # The tails are extras to no one of another component.
    assert made["common_extras"].count() == 0
    # Members of the large component can't reach the others by extras of their own.
    assert made["rest"].count() < 100
    # Holders of one extra in a part share a row.
    assert made["holders"].groupBy("a", "part", "token").count().where("count > 1").count() == 0
