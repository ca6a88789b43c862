"""The ten operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash
from oracle import SMALL, check, connect

from newsloom.llm import chat, language, mixing, packing, pii, queries, simhash, urls

MEDIUM = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fingerprints(spark, docs):
    rows = {r.doc_id: r for r in queries.op1_fingerprint(spark, MEDIUM).collect()}
    assert set(rows) == set(docs)
    order = sorted(docs, reverse=True)
    by_text, errors = defaultdict(set), []

    def shingles(text):
        w = WORD.findall(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for here, after in zip(order, [*order[1:], order[0]], strict=True):
        text, other = docs[here].text or "", docs[after].text or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + other[:cut]
        assert (rows[here].n_chars, rows[here].edited_sha256) == (len(text), sha(edited))
        by_text[text].add(rows[here].fingerprint)
        for guess, (a, b) in ((rows[here].near_edited, (text, edited)), (rows[here].near_next, (text, other))):
            a, b = shingles(a), shingles(b)
            errors.append(abs(guess - (len(a & b) / len(a | b) if a | b else 1.0)))
    assert all(len(prints) == 1 for prints in by_text.values())
    assert np.mean(errors) < 0.02
    assert max(errors) < 0.2


def test_quality_base(spark, docs):
    rows = {r.doc_id: r for r in queries.op2_quality(spark, MEDIUM).collect()}
    assert set(rows) == set(docs)
    for i, row in rows.items():
        text = docs[i].text or ""
        words = WORD.findall(text)
        windows = defaultdict(list)
        for at in range(len(words) - 2):
            windows[tuple(words[at : at + 3])].append(at)
        repeated = {at + k for places in windows.values() if len(places) > 1 for at in places for k in range(3)}
        lines = [line for line in text.split("\n") if WORD.search(line)]
        assert (row.n_words, row.word_chars) == (len(words), sum(map(len, words)))
        assert row.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert row.n_dup_lines == len(lines) - len(set(lines))
        assert row.n_repeat_words == len(repeated)
        assert row.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (row.kept and row.base_failed)


def test_quality_held_to_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in queries.op2_quality(spark, MEDIUM).collect()}
    assert np.mean([kept[i] == bool(q) for i, q in labels.items() if i in kept]) > 0.85


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = queries.op3_toxicity(spark, MEDIUM).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]) > 0.9


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_str(queries.tokenizer_text())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in queries.op4_pack(spark, MEDIUM).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(docs)
    for i, own in pieces.items():
        ids, at = [*coder.encode(docs[i].text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    held = padded = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        held += at
        padded += at if at & (at - 1) == 0 else 4096
    assert held / padded > 0.99


def test_encoder_gives_the_ids_of_whole_texts():
    encoder = packing.Encoder(queries.tokenizer_text())
    texts = ["", ".", "a.", "a..", "x, Y. É. ı,", "it's. 1.", "<", "a<| b|> >", "A<|StartOfText|>b", "<|startoftext|>x <|ENDOFTEXT|>", "á b\nc\td\u00a0e"]
    texts = [*texts, " ".join(texts), "\n".join(texts * 30)]
    for ids, text in zip(encoder.encode(texts), texts, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_plan_keeps_counts():
    draw = random.Random(1)
    histogram = {n: draw.randint(1, 40) for n in draw.sample(range(1, 4096), 200)}
    got = defaultdict(int)
    for length, _, count, _, size, _, _ in packing.plan(histogram):
        got[length] += count * size
    assert got == {length: length * n for length, n in histogram.items()}


def test_language_held_out(spark, docs):
    rows = queries.op5_language(spark, MEDIUM).collect()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]) > 0.95


def brute_spans(text):
    def luhn(digits):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    found = [(m.start(), k, m.end(), kind) for k, (kind, pattern, valid) in enumerate(kinds) for m in re.finditer(pattern, text) if valid(m.group())]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


TRICKY = ("a@b@c.de x", "..@a.b", "1.2.3.4.5.6.7.8", "999.1.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111", "++1 (2) 345-678 90", "\U0001f600 joe@x.org \U0001f600 10.0.0.1", "0 0 0 0 0 0 0 0 0 0 0 0", "+1 2", "a@b.c-.d.", "12345678901234567890123 4111111111111111")


def test_pii_base(spark, docs):
    rows = [(i, r.text) for i, r in docs.items()] + [(-1 - i, t) for i, t in enumerate(TRICKY)]
    texts = dict(rows)
    for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string"), pii.fit(spark)).collect():
        base = brute_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == sha(",".join(base)), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        assert set(base) <= set(r.spans.split(","))


def test_urls(spark):
    rules = queries.URL_RULES

    def judged(url):
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest).group()
            path = re.match(r"[^?#]*", rest[len(host) :]).group()
            host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        best = (None, "allow")
        for verdict, rule in rules:
            h, p = rule.split("/", 1)
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best[0] is None or len(rule) > len(best[0])):
                best = (rule, verdict)
        return (host, path, *best)

    given = [None, "", "org", "http://ORG/", "http://org", "http://a.org/x", "http://xorg/", "https://www.example.org/es/1?q", "http://example.org/en/12", "http://example.org/en", "http://b.com/fr/x", "http://B.com/de/#", "a://b://c", "http://.org/", "http://É.ORG/é"]
    out = urls.filter_urls(spark.createDataFrame(list(enumerate(given)), "page_id long, url string"), rules).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: judged(u) for i, u in enumerate(given)}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    check(queries.QUERIES[name](spark, SMALL), queries.ORACLES[name], connect())


def test_mix(spark, docs):
    rows = {r.doc_id: r for r in queries.op8_mix(spark, MEDIUM).collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, d in docs.items():
        n = len(WORD.findall(d.text or ""))
        assert rows[i].size == n
        assert rows[i].taken in (0, n, 2 * n, 3 * n)
        sizes[d.source] += n
        taken[d.source] += rows[i].taken
        largest[d.source] = max(largest[d.source], n)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    for i, d in docs.items():
        assert rows[i].source_size == sizes[d.source]
        assert rows[i].target == pytest.approx(target[d.source])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    assert {r.doc_id: r.taken for r in queries.op8_mix(spark, MEDIUM).collect()} == {i: r.taken for i, r in rows.items()}


def brute_simhash(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    label = np.arange(len(ids))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return {i: ids[x] for i, x in zip(ids, label, strict=True)}
        label = new


def test_simhash(spark, docs):
    rows = {r.doc_id: r for r in queries.op9_simhash(spark, MEDIUM).collect()}
    prints = {i: brute_simhash(d.text) for i, d in docs.items()}
    assert {i: r.fingerprint for i, r in rows.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in rows.items()} == brute_components(prints)


def test_simhash_links_of_crowded_bands(spark):
    draw = random.Random(3)
    seeds = [draw.getrandbits(64) for _ in range(20)]
    prints = sorted({s ^ sum(1 << b for b in draw.sample(range(20), draw.randint(0, 5))) for s in seeds for _ in range(40)})
    rows = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    expected = brute_components(dict(enumerate(prints)))
    for tile in (8, 1024):
        parent = {int(np.uint64(p).astype(np.int64)): k for k, p in enumerate(prints)}
        group = list(range(len(prints)))
        edges = [(parent[r.a], parent[r.b]) for r in simhash.links(rows, tile=tile).collect()]
        changed = True
        while changed:
            changed = False
            for a, b in edges:
                if group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
        assert dict(enumerate(group)) == expected


def test_chat_round_trip():
    draw = random.Random(4)
    bits = ["\\", "###", "####", "</turn>", " ", "\n", "a", "### user: ", "\\###", "#", "</turn", ">"]
    for _ in range(300):
        turns = [(role, "".join(draw.choices(bits, k=draw.randint(0, 8)))) for role in draw.choices(["user", "assistant"], k=draw.randint(1, 5))]
        text, starts, ends = chat.format_turns(turns)
        assert chat.parse_turns(text) == turns
        assert [chat.show(text[s:e]) for s, e in zip(starts, ends, strict=True)] == [t for role, t in turns if role == "assistant"]


def test_reply_paths(spark):
    draw = random.Random(5)
    rows = [(t, n, draw.randrange(n) if n else None, float(draw.randint(0, 9))) for t in range(8) for n in range(draw.randint(1, 25))]
    got = defaultdict(list)
    for r in chat.paths(spark.createDataFrame(rows, "tree long, node long, parent long, score double"), keep=3).collect():
        got[r.tree, r.branch].append((r.depth, r.node))
    up = {(t, n): p for t, n, p, _ in rows}
    gain = {(t, n): s for t, n, _, s in rows}
    for t in range(8):
        leaves = {n for x, n in up if x == t} - {p for (x, _), p in up.items() if x == t}
        ways = []
        for leaf in leaves:
            way = [leaf]
            while up[t, way[-1]] is not None:
                way.append(up[t, way[-1]])
            ways.append((-sum(gain[t, n] for n in way), -len(way), leaf, way[::-1]))
        for branch, (_, _, _, way) in enumerate(sorted(ways)[:3], 1):
            assert [n for _, n in sorted(got[t, branch])] == way


def test_targets_without_words(spark):
    out = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in out} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
