"""Spelling variants, WARC archives and the conversation trie against brute force and exact round trips."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyarrow import fs

from driftwise.llm import prefix_trie, spelling, warc
from driftwise.llm.common import shared_folder
from tests.llm.conftest import prose


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    form, near = {}, {}
    for w in n:
        beside = [v for v in n if one_edit(w, v)]
        near[w] = len(beside)
        best = min(beside, key=lambda v: (-n[v], v), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], near[w], n.get(form.get(w))) for w in n}


def misspelt(seed):
    """Texts over few letters, with many words at one edit, capitals, letters of Latin-1 and very long runs."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(4, 8))) for _ in range(12)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(80):
            w = r.choice(stems)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                k = r.randrange(len(w) + 1)
                w = w[:k] + r.choice(["", "a", "É", "B", "÷"]) + w[k + r.randint(0, 1):]
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i - 5, r.choice([" ", "-", "1"]).join(words)))
    long = "".join(r.choice("ab") for _ in range(700))
    return rows + [(None, "abcde " * 9 + "ABCDE abcdf"), (900, None), (901, ""), (902, f"{long} {long[:-1]} " * 4), rows[3], rows[3]]


@pytest.mark.parametrize("sizes", [{}, {"shard_letters": 200, "block_letters": 300}])
def test_spelling_as_brute_force(frame, sizes):
    rows = misspelt(3)
    got = [tuple(r) for r in spelling.variants(frame(rows), **sizes).collect()]
    want = plain_variants(rows)
    assert len(got) == len(set(got)) and set(got) == want
    assert sum(form is not None for _, form, *_ in want) > 50 and any(root != (form or word) for word, form, root, *_ in want)


def test_spelling_of_prose_and_of_nothing(frame):
    rows = prose(8)
    assert {tuple(r) for r in spelling.variants(frame(rows)).collect()} == plain_variants(rows)
    empty = spelling.variants(frame([]))
    assert empty.columns == ["word", "form", "root", "n", "n_near", "form_n"] and empty.collect() == []


PAGES = "page_id long, url string, html string, key string, file string, offset string, sha string, top string"


@pytest.fixture
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "k", "f", "o", "s", "t") for r in rows], PAGES).repartition(3)

    return make


def some_pages(seed):
    r = random.Random(seed)
    bodies = ["", "<p>é\r\n\r\nx</p>", "WARC/1.1\r\n\r\n", "y" * 200_000, *["<b>%d</b>" % i for i in range(20)]]
    rows = [(i, f"http://{r.choice('abc')}.Example.org:80/p/{r.randrange(40)}?q={r.choice('xy')}#f", r.choice(bodies)) for i in range(300)]
    return rows + [(None, None, None), (None, "no scheme/x y\n", "only here"), (5000, None, "<p>own</p>"), (5001, "ftp://user@h:80", None),
                   (7000, "http://t.org/", "tie"), (7000, "http://t.org/", "tie"), (6999, "http://t.org/", "tie"), *rows[:2]]


def plain_archive(rows):
    top = {}
    for page, _, html in rows:
        held = top.get(html or "")
        top[html or ""] = page if held is None else held if page is None else max(held, page)
    out = Counter()
    for page, url, html in rows:
        body = (html or "").encode()
        first = page == top[html or ""]
        out[(page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
             "response" if first else "revisit", None if first else top[html or ""])] += 1
    return out


COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_archive_as_brute_force(pages):
    rows = some_pages(4)
    assert Counter(tuple(r) for r in warc.archived(pages(rows)).select(*COLUMNS).collect()) == plain_archive(rows)
    assert warc.archived(pages([])).collect() == []
    none = warc.archived(pages(rows), least_bytes=1 << 20)
    assert {r.record_type for r in none.collect()} == {"response"}


def test_index_finds_every_capture_of_a_key_and_no_other(spark, pages, tmp_path):
    rows = some_pages(5)
    folder = f"{shared_folder(spark)}/warc-test-{tmp_path.name}-{random.random()}"
    captures = warc.write(pages(rows), folder)
    shards = warc.index(captures, folder, lines=3, shard_captures=20)
    assert shards.count() > 5
    asked = ["HTTP://A.example.org/p/3?q=x", "http://t.org/", "http://t.org/#z", "http://nowhere.org/", "", None, "no scheme/x y\n"]
    found = warc.lookup(spark.createDataFrame([(u,) for u in asked], "url string"), shards, folder)
    keys = {warc.url_key(u) for u in asked}
    want = Counter((warc.url_key(u), p) for p, u, _ in rows if warc.url_key(u) in keys)
    assert Counter((r.key, r.page_id) for r in found.collect()) == want and len(want) > 4
    read = warc.fetch(found, folder).collect()
    html = {(p, h or "") for p, _, h in rows}
    assert all((r.page_id, r.payload.decode()) in html for r in read if r.record_type == "response")
    assert len(read) == sum(want.values()) and all(r.payload is None for r in read if r.record_type == "revisit")


def test_archive_is_plain_gzip_warc(spark, pages, tmp_path):
    folder = f"{shared_folder(spark)}/warc-plain-{tmp_path.name}-{random.random()}"
    captures = warc.write(pages(some_pages(6)), folder).collect()
    system, root = fs.FileSystem.from_uri(folder)
    for name in {r.file for r in captures}:
        whole = gzip.decompress(system.open_input_file(f"{root}/{name}").read())
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ")
        ids = re.findall(rb"WARC-Record-ID: (\S+)", whole)
        assert len(ids) >= sum(r.file == name for r in captures)
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(warc.record(1, "u", b"abc", "A" * 32, None, True, "f/0"))


def test_keys_order_by_host():
    assert warc.url_key("https://Blog.Example.org:443/a?b#c") == "org,example,blog)/a?b"
    assert warc.url_key("http://h:8080?q") == "h:8080)/?q"
    assert warc.url_key(None) == ")/"


CONVERSATIONS = "conv_id long, turn long, role string, text string, path string, words string, shard string, skeleton string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), role, key, text))
    turns = {c: [(role, text) for _, role, _, text in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = turns.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        tokens = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += tokens
    out = Counter()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        out[(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
             hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def talks(seed):
    """Conversations with shared beginnings, hundreds of copies, ties, nulls, one of 400 turns, and turnless ones."""
    r = random.Random(seed)
    bank = [(role, " ".join(r.choice(["a", "é", "\t", "bb", "\n"]) for _ in range(r.randint(0, 5)))) for role in ("user", "bot") for _ in range(3)]
    rows = []
    for c in [*range(-25, 300), 10**12, 10**12 + 1]:
        path = [bank[0]] * 3 if r.random() < 0.4 else [r.choice(bank) for _ in range(r.randint(1, 6))]
        rows += [(c, None if k == 2 and r.random() < 0.2 else k, *t) for k, t in enumerate(path)]
    rows += [(2001, k, "user", str(k % 3)) for k in range(400)] + [(2002, k, "user", str(k % 3)) for k in range(390)]
    rows += [(3001, 0, None, None), (3002, 0, "", ""), (3003, 0, "ab", "c"), (3004, 0, "a", "bc"), (None, 1, "user", "x"), (3005, 4, "u", "1"), (3005, 4, "u", "0")]
    rows += [rows[0], rows[0]]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shards", "sampled"), [(1, 20), (4, 20), (60, 1)])
def test_trie_as_brute_force(spark, shards, sampled, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SAMPLED", sampled)
    monkeypatch.setattr(prefix_trie, "CHUNK", 20)
    rows = talks(2)
    table = spark.createDataFrame([(*r, "p", "w", "s", "k") for r in rows], CONVERSATIONS).repartition(3)
    got = prefix_trie.trie(prefix_trie.paths(prefix_trie.rebuilt(table)), shards)
    assert Counter(tuple(r) for r in got.collect()) == plain_trie(rows)


def test_trie_of_nothing_and_of_long_conversations(spark, monkeypatch):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.conversation_trie(empty).collect() == []
    assert prefix_trie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "", "", "", "")], CONVERSATIONS)).collect() == []
    # Too long for more than one shard: no splitter, and the root is the whole skeleton.
    monkeypatch.setattr(prefix_trie, "SKELETON", 100)
    rows = talks(5)
    table = spark.createDataFrame([(*r, "p", "w", "s", "k") for r in rows], CONVERSATIONS)
    assert Counter(tuple(r) for r in prefix_trie.conversation_trie(table).collect()) == plain_trie(rows)
