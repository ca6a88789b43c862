"""Added spans judged on sentences that no template produced, and texts full of matches."""

import random
import time

import pytest

from newsloom.llm import pii

#: (text, items): what is personal data in it, none elsewhere.
SENTENCES = (
    ("Anna said to ring her on 415-555-0132 before noon.", ["415-555-0132"]),
    ("The office line, (212) 555-0187, is busy all day.", ["(212) 555-0187"]),
    ("From abroad dial +44 20 7946 0958 and wait.", ["+44 20 7946 0958"]),
    ("Our London number is 020 7946 0958 these days", ["020 7946 0958"]),
    ("You can text 650.555.0199 for a quote.", ["650.555.0199"]),
    ("Fax 303 555 0144 if the mail is down", ["303 555 0144"]),
    ("joe AT example DOT com is where bills go", ["joe AT example DOT com"]),
    ("Complaints: mary.jones [at] shop [dot] org, thanks", ["mary.jones [at] shop [dot] org"]),
    ("he is bob(at)corp(dot)net on every site", ["bob(at)corp(dot)net"]),
    ("write peter at firm dot example for the keys", ["peter at firm dot example"]),
    ("the card 5500 0000 0000 0004 was refused", ["5500 0000 0000 0004"]),
    ("charged to 3782 822463 10005 yesterday", ["3782 822463 10005"]),
    ("gateway 192[.]168[.]10[.]250 dropped packets", ["192[.]168[.]10[.]250"]),
    ("it answered from 10 . 20 . 30 . 44 twice", ["10 . 20 . 30 . 44"]),
    ("built 2021-03-04 10:22:33 by the robot", []),
    ("sku 555-123-4567 is out of stock", []),
    ("the meeting of 04/05/2023 moved to 05/06/2023", []),
    ("open 2019-11-30 to 2020-01-15 only", []),
    ("invoice 8841230077 was paid", []),
    ("it cost 1 250 000 euros in 1998", []),
    ("see pages 1024-1049 and 2200-2214", []),
    ("ISBN 978-3-16-148410-0 is a test", []),
    ("version 4.12.0.7 fixes that", []),
    ("we looked at everything dot by dot", []),
    ("they met at noon.nobody knew", []),
    ("order 4929 1234 5678 9012 shipped", []),
    ("tracking no. 940011189922385", []),
    ("between 1914 and 1918, then 1939 to 1945", []),
    ("mix 250 ml with 100 g at 180 degrees", []),
    ("batch 20230405 of 20230406", []),
)


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(spark)


def test_precision_and_recall_of_added_spans(spark, model):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)], "doc_id long, text string")
    hit = wrong = wanted = 0
    for r in pii.find(rows, model).collect():
        text, items = SENTENCES[r.doc_id]
        base = {(x.s, x.e) for x in r.base}
        found = [text[x.s : x.e] for x in r.found]
        hit += sum(i in found for i in items)
        wanted += len(items)
        wrong += sum(text[x.s : x.e] not in items for x in r.found if (x.s, x.e) not in base)
    assert hit / wanted >= 0.85
    assert hit / (hit + wrong) >= 0.85


def test_calibration_shares_no_template(spark):
    assert not {t for _, t in pii.TEMPLATES} & {t for _, t in pii.CALIBRATION}


def test_a_text_full_of_matches(spark, model):
    """Twenty thousand addresses and numbers in one text, as far from quadratic as a minute is from an hour."""
    draw = random.Random(11)
    items = [draw.choice([f"u{i}@h{i}.org", f"10.{i % 256}.0.1", f"joe{i} at mail dot org"]) for i in range(20_000)]
    text = ", ".join(items)
    start = time.perf_counter()
    row = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert time.perf_counter() - start < 120
    assert row.n_email == sum("@" in x for x in items)
    assert row.n_ip == sum(x[0] == "1" for x in items)
    spans, at = {tuple(map(int, x.split(":")[1:])) for x in row.spans.split(",")}, 0
    for x in items:
        assert (at, at + len(x)) in spans
        at += len(x) + 2
    out = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().text
    assert out == ", ".join("[IP]" if x[0] == "1" else "[EMAIL]" for x in items)


def test_long_runs_of_digits(spark, model):
    rows = [(0, "1" * 50_000), (1, "10.0.0.1." * 3000), (2, "+" * 50_000), (3, "a" * 100_000 + "@" + "b." * 20_000 + "c")]
    out = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [out[i].n_email for i in range(4)] == [0, 0, 0, 1]
    assert out[0].spans == "" and out[2].spans == ""
