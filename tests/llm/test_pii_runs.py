"""Personal data with other numbers directly before and after it."""

import pytest

from newsloom.llm import pii

ITEMS = (
    ("email", "joe at mail dot org"),
    ("ip", "10[.]20[.]130[.]41"),
    ("ip", "10.0.0.1"),
    ("card", "4111 1111 1111 1111"),
    ("card", "4111111111111111"),
    ("phone", "(555) 123-4567"),
    ("phone", "555-123-4567"),
    ("phone", "+1 (555) 123-4567"),
)


@pytest.fixture(scope="module")
def found(spark):
    model = pii.fit(spark)

    def of(texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {r.doc_id: (r.base, [(x.s, x.kind, x.e) for x in r.found]) for r in pii.find(rows, model).collect()}

    return of


def test_items_beside_items(found):
    pairs = [(a, b) for a in ITEMS for b in ITEMS]
    out = found([f"the {a} {b} of" for (_, a), (_, b) in pairs])
    for i, ((ka, a), (kb, b)) in enumerate(pairs):
        base, spans = out[i]
        wanted = [(4, pii.KINDS.index(ka), 4 + len(a)), (5 + len(a), pii.KINDS.index(kb), 5 + len(a) + len(b))]
        # a base span that runs on into the neighbour stays as it is, and nothing that overlaps it is added
        assert all(x in spans or any(y.s < x[2] and x[0] < y.e for y in base) for x in wanted), (a, b, spans)


def test_runs_of_the_review(found):
    phone = pii.KINDS.index("phone")
    out = found(["555 123 4567 555 987 6543", "2021 (555) 123-4567", "Des +1 (826) 555-4081 190.137.223.20", "at 43 4111 1111 1111 1111 of", "call 555-123-4567 4th"])
    assert [out[i][1] for i in range(5)] == [[(0, phone, 12), (13, phone, 25)], [(5, phone, 19)], [(4, phone, 21), (22, 1, 36)], [(6, 2, 25)], [(5, phone, 17)]]
