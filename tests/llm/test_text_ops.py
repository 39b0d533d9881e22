"""Small cases and brute force for the operators on texts."""

import hashlib
import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from distinctspark.llm import chaining, html, mixing, ordinal, pieces, pii
from distinctspark.llm.components import components
from distinctspark.llm.linededup import drop_repeated_runs
from distinctspark.llm.minhash import near_duplicates
from distinctspark.llm.syncmers import fingerprints
from distinctspark.llm.words import window_hashes, word_chunks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, ids string"


def frame(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame(
        [(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """NULLs, empty, blank, very long, repeated and tied rows."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 12) for _ in range(3000))
    return [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one", "b"), (None, "no id at all here", "b"),
            (5, long, "a"), (6, long, "c"), (7, "x" * 100_000, "c"), (8, "héllo ▁ wörld 😀 again now", None),
            (8, "héllo ▁ wörld 😀 again now", None), (9, "a b c\na b c\na b c\na b c", "b")]


def test_words_match_a_plain_split():
    texts = ["", None, "Aa bB\tcc\x0bdd", " é ü ", "tail", "x y z"]
    chunk = next(word_chunks(pa.array(texts)))
    found = [[bytes(chunk.data[s:e]).decode() for s, e in zip(chunk.starts, chunk.ends)][a:b]
             for a, b in zip(chunk.offsets[:-1], chunk.offsets[1:])]
    assert found == [[w for w in re.split("[ \t-\r]", t or "") if w] for t in texts]
    same = next(word_chunks(pa.array(["the Cat sat on", "x the cAT sat on"])))
    a, at = window_hashes(same, 3)
    assert a[0] == a[3] and a[1] == a[4] and len(at) == 5


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(None, 3), (7, 7)]
    links += [(1000, 1000 + i) for i in range(1, 300)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in links:
        if u is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates_against_all_pairs(spark, odd_rows):
    rng = random.Random(2)
    base = prose(rng, 120).split()
    rows = list(odd_rows)
    for i in range(100, 220):  # one group of near copies, many of them apart from each other
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"edit{rng.randint(0, 99)}"
        rows.append((i, " ".join(words), "a"))
    got = near_duplicates(frame(spark, rows)).collect()
    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), comp[r.doc_id])
            assert r.kept == (r.doc_id == r.component_id)
    assert near_duplicates(frame(spark, [])).count() == 0


def test_pipeline_drops_near_copies_from_0_8(spark):
    rng, rows = random.Random(17), []
    for g in range(0, 60, 2):  # one edit in the middle changes 5 of n - 4 shingles
        words = prose(rng, 40 + g).split()
        rows.append((g, " ".join(words), "a"))
        words[20] = "edit"
        rows.append((g + 1, " ".join(words), "a"))
    sets = {i: shingles(t) for i, t, _ in rows}
    share = {g: len(sets[g] & sets[g + 1]) / len(sets[g] | sets[g + 1]) for g in range(0, 60, 2)}
    assert any(s < 0.8 for s in share.values()) and any(0.8 <= s < 0.85 for s in share.values())
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "").collect()}
    assert left == set(share) | {g + 1 for g, s in share.items() if s < 0.8}


def test_line_runs(spark, odd_rows):
    got = {(r.doc_id, r.source): r for r in drop_repeated_runs(frame(spark, odd_rows)).collect()}
    assert got[(1, "a")].text is None and got[(2, "a")].text == ""
    assert got[(5, "a")].n_removed == 0 and got[(6, "c")].text == ""
    assert got[(9, "b")].text == "a b c" and got[(9, "b")].n_removed == 3
    assert got[(8, None)].n_removed == 0 and got[(5, "a")].ids == "y"
    kept = drop_repeated_runs(frame(spark, [
        (1, "a\nb\nc\nd", "s"), (2, "x\nb\n\nc\nd\ny", "s"), (3, "c\nd\nz", "s")]))
    assert {r.doc_id: r.text for r in kept.collect()} == {1: "a\nb\nc\nd", 2: "x\n\ny", 3: "c\nd\nz"}
    assert drop_repeated_runs(frame(spark, [])).count() == 0


def test_fingerprints_against_plain_code(spark, odd_rows):
    xxhash = pytest.importorskip("xxhash")
    rows = [r for r in odd_rows if r[0] not in (7,)] + [(20 + i, prose(random.Random(i), 5 * i), "a") for i in range(20)]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def of_long(v, seed):
        return xxhash.xxh64(struct.pack("<q", v), seed=seed & ((1 << 64) - 1)).intdigest()

    def pair(a, b):
        return signed(of_long(b, of_long(a, 42)))

    def anchors(text):
        h = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in re.split("[ \t-\r]", text) if w]
        if len(h) < 8:
            whole = 42
            for v in h:
                whole = of_long(v, whole)
            return [signed(whole) >> 32] if h else []
        h2 = [pair(*x) for x in zip(h, h[1:])]
        h4 = [pair(*x) for x in zip(h2, h2[2:])]
        h8 = [pair(*x) for x in zip(h4, h4[4:])]
        picked = [h8[i] >> 32 for i in range(len(h) - 7) if min(h2[i:i + 7]) in (h2[i], h2[i + 6])]
        return list(dict.fromkeys(picked))

    order = sorted({(i if i is not None else -(1 << 63), t or "") for i, t, _ in rows}, reverse=True)
    texts = [t for _, t in order]
    got = fingerprints(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        at = [i for i, _ in order].index(r.doc_id if r.doc_id is not None else -(1 << 63))
        text, after = texts[at], texts[(at + 1) % len(texts)]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        a, b, c = anchors(text), anchors(edited), anchors(after)
        near = [len({*a} & {*x}) / len({*a} | {*x}) if a or x else 1.0 for x in (b, c)]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == " ".join(map(str, a)) and r.edited_fingerprint == " ".join(map(str, b))
        assert (r.near_edited, r.near_next) == pytest.approx(tuple(near))
    assert fingerprints(frame(spark, [])).count() == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
       "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
       "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_base_entities_against_the_patterns():
    rng = random.Random(3)
    parts = ["a", "b.", "@", ".", "1", "23", "255", "256", "+", "-", " ", "(", "x@y.z", "4111111111111111",
             "é", "10.0.0.1", "_", "+1 (234) 555-0199"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        want = {}
        for kind, pattern in PII.items():
            want[kind] = []
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                        "card": 13 <= len(digits) <= 19 and pii._luhn(digits), "phone": 9 <= len(digits) <= 15}
                want[kind] += [m.span()] * good[kind]
        assert pii.base_spans(text) == want, text


def test_bootstrapped_identifiers(spark, odd_rows):
    rng = random.Random(4)
    rows = [(100 + i, f"{prose(rng, 6)} please dial number +1 (234) 555-{1000 + i} {prose(rng, 6)}", "a") for i in range(8)]
    rows += [(200, "ééé please dial number 5551234 now", "a"), (201, f"the year 20241234 {prose(rng, 5)}", "a")]
    got = {r.doc_id: r for r in pii.personal_data(frame(spark, odd_rows + rows)).collect()}
    assert got[100].n_phone == 1 and got[200].n_phone == 0
    assert got[200].spans == "phone:23:30" and got[201].spans == ""
    assert got[200].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[1].spans == "" and len(got) == 20
    assert pii.personal_data(frame(spark, [])).count() == 0


def plain_bootstrap(texts):
    """Spans that the graph adds, computed with dictionaries."""
    mentions, totals = [], {}
    for i, text in enumerate(texts):
        low = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
               for w in re.findall(r"[^ \t-\r]+", text)]
        ends = [m.end() for m in re.finditer(r"[^ \t-\r]+", text)]
        for pair in zip(low, low[1:]):
            totals[pair] = totals.get(pair, 0) + 1
        base = pii.base_spans(text)
        taken = [s for own in base.values() for s in own]
        seeds = pii.secret_seeds(text, taken)
        every = [(k, s) for k in pii.KINDS for s in base[k]] + [("secret", s) for s in seeds]
        every += [(None, s) for s in pii.candidate_spans(text, taken + seeds)]
        for kind, (a, b) in every:
            n = sum(e <= a for e in ends)
            mentions.append((i, kind, a, b, tuple(low[n - 2 : n]) if n >= 2 else None, text[a:b].lower()))
    entities = {}
    for _, kind, _, _, pattern, value in mentions:
        if kind and pattern:
            entities.setdefault((pattern, kind), set()).add(value)
    strong = {key for key, own in entities.items() if len(own) >= pii.MIN_ENTITIES}
    score = {}
    for _ in range(pii.ROUNDS):
        trust = {}
        for pattern, kind in strong:
            own = [(1.0 if k == kind else 0.0) if k else score.get((v, kind), 0.0)
                   for _, k, _, _, p, v in mentions if p == pattern]
            trust[pattern, kind] = sum(own) / (totals[pattern] + pii.PRIOR)
        miss = {}
        for _, k, _, _, p, v in mentions:
            for (pattern, kind), c in trust.items():
                if k is None and p == pattern and c >= pii.TRUST:
                    miss[v, kind] = miss.get((v, kind), 1.0) * max(1 - c, 1e-12)
        score = {key: 1 - m for key, m in miss.items()}
    best = {}
    for (v, kind), s in score.items():
        if s >= pii.ACCEPT:
            best[v] = max(best.get(v, (0, "")), (s, kind))
    added = {(i, "secret", a, b) for i, k, a, b, _, _ in mentions if k == "secret"}
    return added | {(i, best[v][1], a, b) for i, k, a, b, _, v in mentions if k is None and v in best}


def test_bootstrapped_spans_equal_the_plain_graph(spark):
    rng = random.Random(17)

    def key(n):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    texts = [f'{prose(rng, 9)} token = "{key(40)}" {prose(rng, 4)}' for _ in range(9)]
    texts += [f'{prose(rng, 5)} TOKEN = "{key(40).upper()}"!! {prose(rng, 3)}', f'ab token = "k-{key(12)}-4711" end',
              'cd token = "plain" end', f"loose {key(16)} 12345678 {prose(rng, 4)}"]
    texts += [f"{prose(rng, 3)} write to user{i}@mail.example.org today {prose(rng, 3)}" for i in range(20)]
    texts += ["please write to user7@intranet now", "we write to them", f"number is 10.1.2.{rng.randint(1, 9)} ok"]
    texts += [f"seen at {rng.randint(1, 9)}.2.3.{i} by" for i in range(5)] + ["seen at 99.2.3.4000 by", "seen at noon by"]
    want = plain_bootstrap(texts)
    docs = frame(spark, [(i, t, "a") for i, t in enumerate(texts)])
    base = {(i, k, a, b) for i, t in enumerate(texts) for k, own in pii.base_spans(t).items() for a, b in own}
    got = set()
    for r in pii.personal_data(docs).collect():
        for part in filter(None, r.spans.split(",")):
            kind, a, b = part.split(":")
            got.add((r.doc_id, kind, int(a), int(b)))
    assert got == base | want
    found = {texts[i][a:b] for i, k, a, b in want}
    assert any(v.isupper() for v in found) and any(v.endswith("-4711") for v in found) and "user7@intranet" in found
    assert "12345678" not in found and "plain" not in found


def edited(rng, words, n):
    """Copies of ``words`` with ``n`` words replaced, dropped or doubled at random places."""
    out = list(words)
    for at in sorted(rng.sample(range(len(out)), n), reverse=True):
        out[at : at + 1] = rng.choice([[prose(rng, 1) + "q"], [], [out[at], prose(rng, 1) + "z"]])
    return out


def test_near_passages_with_edits_anywhere(spark):
    """Gapped ends: 60 words with two edits and 200 words with ten are found, from first to last."""
    rng = random.Random(41)
    rows, want = [], {}
    for i, (n, edits) in enumerate([(60, 1), (60, 2)] * 12 + [(200, 10)] * 8):
        passage = prose(rng, n).split(" ")
        near = edited(rng, passage, edits)
        rows += [(2 * i, " ".join([prose(rng, 40), *passage, prose(rng, 40)]), "a"),
                 (2 * i + 1, " ".join([prose(rng, 30), *near, prose(rng, 30)]), "a")]
        want[2 * i + 1] = (2 * i, 30, 30 + len(near))
    got = {}
    for r in chaining.fuzzy_passages(frame(spark, rows)).collect():
        own = got.setdefault(r.doc_id, r)
        got[r.doc_id] = max(own, r, key=lambda r: r.end - r.start)
    assert set(got) >= set(want)
    for doc, (source, start, end) in want.items():
        r = got[doc]
        assert r.source_doc_id == source and r.start >= start - 6 and r.end <= end + 6
        # What no seed reaches within MARGIN words may be left out of a long one.
        assert r.end - r.start >= (end - start - 12 if end - start < 100 else 0.6 * (end - start))
        assert r.matched >= 0.8 * (r.end - r.start)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_every_near_passage_at_the_threshold(spark):
    """Edits spread evenly or at random, to 80 % identity; a near copy of a near copy as well."""
    rng = random.Random(12)
    rows, want, doc = [], {}, 0

    def document(words):
        nonlocal doc
        doc += 1
        rows.append((doc, " ".join([prose(rng, 30), *words, prose(rng, 35)]), "a"))
        return doc

    def even(words, step):
        return [w + "q" if i % step == step // 2 else w for i, w in enumerate(words)]

    for n, edits in [(52, 10), (60, 4), (60, 6), (60, 11), (200, 20), (200, 39)] * 3:
        passage = prose(rng, n).split(" ")
        first = document(passage)
        near = edited(rng, passage[1:-1], edits)
        near = [passage[0], *near, passage[-1]]
        want[document(near)] = first, len(near), edit_distance(passage, near) <= 0.2 * max(n, len(near))
        want[document(even(passage, 5))] = first, n, True
        # Near the second copy only: both its edits and others.
        other = [w + "z" if i % 5 == 4 and 0 < i < n - 1 else w for i, w in enumerate(even(passage, 5))]
        want[document(other)] = doc, n, True
    got = {}
    for r in chaining.fuzzy_passages(frame(spark, rows)).collect():
        assert max(r.end - r.start, r.source_end - r.source_start) >= 50
        assert r.matched >= 0.8 * max(r.end - r.start, r.source_end - r.source_start)
        got.setdefault((r.doc_id, r.source_doc_id), []).append(r)
    for key, (source, n, near) in want.items():
        assert not near or (key, source) in got, (key, source, n)
        if near and n < 100:
            assert max(r.end - r.start for r in got[key, source]) >= 48


def test_near_spans_against_brute_force():
    """Wherever a window of 50 words is within 10 edits of one of the other text, a passage is found."""
    rng = random.Random(13)
    for n in range(40):
        passage = [rng.randrange(10**6) for _ in range(50)]
        near = list(passage)
        for at in rng.sample(range(1, 49), rng.choice([3, 8, 10, 10, 14])):
            near[at] = -1
        a, b = ([rng.randrange(10**6, 10**7) for _ in range(rng.randrange(40))] + own for own in (passage, near))
        distance = edit_distance(passage, near)
        shift = len(b) - len(a)
        found = chaining.near_spans(np.array(a), np.array(b), shift - 10, shift + 10)
        assert len(found) == (distance <= 10), (n, distance)
        for start, end, source, stop, matched in found:
            assert (start, end, source, stop) == (len(a) - 50, len(a), len(b) - 50, len(b)) and matched == 50 - distance


def test_rare_grams_keep_one_of_every_near_window():
    rng = random.Random(14)
    none = np.zeros(0, np.int64)
    for _ in range(50):
        n = {h: rng.choice([2, 2, 3, 50, 1000]) for h in range(200)}
        shared = rng.sample(range(200), chaining.COMMON)
        sides = []
        for side in range(2):
            own = shared + [h for h in rng.sample(range(200), 30) if h not in shared]
            pos = np.sort(np.array(rng.sample(range(48), len(own[:48]))))
            h = np.array(own[:48])
            rng.shuffle(own)
            kept, mine = chaining.rare_grams(pos, h << 30, np.array([n[v] for v in h.tolist()]), none, none, none > 0)
            assert (kept == mine).all()
            sides.append(set(h[kept].tolist()))
        assert sides[0] & sides[1] & set(shared)
    pos = np.arange(60)
    for exact in (False, True):
        kept, mine = chaining.rare_grams(pos, pos << 30, np.full(60, 2), np.array([0]), np.array([62]), np.array([exact]))
        assert kept.any() != exact and not mine.any()


def test_ends_move_over_edits():
    a = np.arange(30)
    assert chaining.extend(a, a) == (30, 30, 30)
    assert chaining.extend(a, a + 100) == (0, 0, 0) == chaining.extend(a[:0], a)
    assert chaining.extend(a, np.r_[a[:5], 99, a[5:20]]) == (20, 21, 20)
    assert chaining.extend(np.r_[a[:8], 98, a[9:25]], np.r_[a[:25], 77, 78]) == (25, 25, 24)


def test_short_texts_have_anchors(spark):
    rng = random.Random(31)
    rows = [(i, prose(rng, 8 + i % 5), "a") for i in range(60)]
    got = fingerprints(frame(spark, rows)).collect()
    assert all(r.fingerprint and r.edited_fingerprint for r in got)
    assert max(r.near_next for r in got) < 0.5


def test_html_rules():
    page = ('<html><body class="no-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use '
            "cookies for the best of it.</div><main><h2>Title</h2><p>The story of the man and the sea was told in "
            'one of the books.<p>Short &amp; done&nbsp;now<br>ok<div class="comments"><p>I think that the story is '
            "not the best of them all</p></div><aside>More of it</aside></main><script>x='</p>'</script><footer>f")
    assert html.main_text(page) == ("Title\n\nThe story of the man and the sea was told in one of the books."
                                    "\n\nShort & done now ok")
    plain = ("<div><a href=/>Home</a> <a href=/b>Blog</a></div><div><h1>My Title</h1><p>The story of the man and the "
             "sea was told in one of the books.</p><p>Yes.</p><p>And the rest of it is in the hands of the people "
             "who read.</p></div><div><a href=1>One</a></div>")
    assert html.main_text(plain).split("\n\n")[0] == "My Title" and "\n\nYes.\n\n" in html.main_text(plain)
    assert html.main_text(None) == html.main_text("") == html.main_text("<p") == ""


SENTENCE = "The report of the committee was read to the members and it was agreed that the work will go on."
TEASER = "A short note on the work that is to be done in the town."
ITALIAN = "Questo paragrafo racconta una piccola storia molto vecchia, ambientata vicino alle grandi montagne innevate."


@pytest.mark.parametrize("page,kept,gone", [
    (f'<div class="layout-with-sidebar"><article><p>{SENTENCE}</article></div>', [SENTENCE], []),
    (f'<div class="entry comments-closed"><p>{SENTENCE}</p></div>', [SENTENCE], []),
    (f'<div class="page no-sidebar"><div><p>{SENTENCE}</p></div></div>', [SENTENCE], []),
    (f'<form id="aspnetForm"><div class="menu">Home</div><p>{SENTENCE}</p></form>', [SENTENCE], ["Home"]),
    (f"<article><p>{TEASER}</p></article><div><p>{SENTENCE}</p><p>{SENTENCE}</p></div>", [SENTENCE], []),
    (f"<div><p>{ITALIAN}</p></div><ul><li><a href=x>Chi siamo</a></ul>", [ITALIAN], ["Chi siamo"]),
    # Names still count beside a page's text, and so do elements.
    (f'<div><p>{SENTENCE}</p></div><div class="comments"><p>{TEASER}</p></div>', [SENTENCE], [TEASER]),
    (f"<nav><p>{TEASER}</p></nav><div><p>{SENTENCE}</p></div><footer>{TEASER}</footer>", [SENTENCE], [TEASER]),
    (f'<aside class="related"><article><p>{TEASER}</p></article></aside><main><p>{SENTENCE}</main>', [SENTENCE], [TEASER]),
    (f'<div hidden><p>{SENTENCE}</p></div><p>{TEASER}</p>', [TEASER], [SENTENCE]),
    ('<nav><a href="1">One</a></nav><footer>All rights of the owner are held by the owner of the page.</footer>', [], ["All"]),
])
def test_hints_are_no_verdicts(page, kept, gone):
    text = html.main_text(page)
    assert all(k in text for k in kept) and not any(g in text for g in gone)


def test_the_two_passes_decide_without_names():
    """No article, no class: length, stop words, links and neighbours tell the blocks apart."""
    page = (f"<div><a href=1>Home</a> <a href=2>News of the day and of the world</a></div><h2>Part one</h2>"
            f"<p>{SENTENCE}</p><p>Yes.</p><p>{SENTENCE}</p><div><a href=3>Next page</a></div><div>Imprint 2020</div>")
    found, hinted = html.blocks(page)
    html.classify(found, hinted)
    assert [b.text[:8] for b in found if b.label] == ["Part one", "The repo", "Yes.", "The repo"]
    assert [b.text for b in found if not b.label][-1] == "Imprint 2020"


def test_very_long_and_repeated_pages(spark):
    long = "".join(f"<p>{SENTENCE} {i}</p>" for i in range(20_000))
    pages = spark.createDataFrame([(1, "u", long), (2, "u", f"<p>{SENTENCE}"), (2, "u", f"<p>{SENTENCE}")],
                                  "page_id long, url string, html string")
    got = sorted((r.page_id, len(r.text)) for r in html.extract_text(pages).collect())
    want = len("\n\n".join(f"{SENTENCE} {i}" for i in range(20_000)))
    assert got == [(1, want), (2, len(SENTENCE)), (2, len(SENTENCE))]


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, "<article><p>Be.", "z"), (None, None, None)], "page_id long, html string, text string")
    got = {r.page_id: r.text for r in html.extract_text(pages).collect()}
    assert got == {1: "Be.", None: ""} and html.extract_text(pages.limit(0)).count() == 0


def test_passages_cover_every_shared_run(spark, odd_rows):
    rng = random.Random(6)
    shared = [prose(rng, n) for n in (50, 60, 90)]
    rows = list(odd_rows)
    for i in range(30, 90):
        rows.append((i, " ".join([prose(rng, rng.randint(0, 80)), shared[i % 3], prose(rng, 30)]), "a"))
    fuzzy = shared[2].split()
    fuzzy[30], fuzzy[31:33] = "edit", ["other"]
    rows.append((95, f"{prose(rng, 20)} {' '.join(fuzzy)} {prose(rng, 20)}", "a"))
    got = chaining.fuzzy_passages(frame(spark, rows)).collect()
    pairs = {(r.doc_id, r.source_doc_id) for r in got}
    assert {(i, 30 + i % 3) for i in range(33, 90)} | {(95, 32)} <= pairs and (6, 5) in pairs
    assert len(got) < 2 * len(rows)
    words = {i: (t or "").split() for i, t, _ in rows}
    for r in got:
        a, b = words[r.doc_id][r.start:r.end], words[r.source_doc_id][r.source_start:r.source_end]
        assert max(len(a), len(b)) >= 50 and r.matched >= 0.8 * max(len(a), len(b))
        assert r.doc_id == 95 or a == b
    assert chaining.fuzzy_passages(frame(spark, [])).count() == 0


def test_passages_whose_parts_stand_in_other_documents(spark):
    rng = random.Random(16)
    rows, words = [], {}
    for g in range(0, 200, 10):
        parts = [prose(rng, rng.randint(30, 60)) for _ in range(2 + g % 3)]
        for i, part in enumerate(parts):
            rows.append((g + i, f"{prose(rng, 20)} {part} {prose(rng, 20)}", "a"))
        for i in (6, 7):
            rows.append((g + i, f"{prose(rng, 20)} {' '.join(parts)} {prose(rng, 20)}", "a"))
    rows += [(500, " ".join(["p q r"] * 60), "a"), (None, "x " * 99, "a")]
    words = {i: t.split() for i, t, _ in rows if i is not None}
    spans = {}
    for r in chaining.fuzzy_passages(frame(spark, rows)).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
        a, b = words[r.doc_id][r.start:r.end], words[r.source_doc_id][r.source_start:r.source_end]
        assert len(a) >= 50 and a == b and r.matched == len(a)
        assert (r.source_doc_id, r.source_start) < (r.doc_id, r.start)
    seen = set()
    for i in sorted(words):
        for p in range(len(words[i]) - 49):
            window = tuple(words[i][p:p + 50])
            assert window not in seen or any(s <= p and p + 50 <= e for s, e in spans.get(i, [])), (i, p)
            seen.add(window)


def test_chains_against_all_subsets():
    rng = random.Random(7)
    for _ in range(200):
        anchors = sorted({(rng.randint(0, 40), rng.randint(0, 40), rng.randint(1, 9)) for _ in range(7)})

        def score(chain):
            total = sum(a[2] for a in chain)
            for (x, y, n), (x2, y2, _) in zip(chain, chain[1:]):
                if x + n > x2 or y + n > y2:
                    return -1
                total -= chaining.GAP_COST * (x2 - x - n + y2 - y - n)
            return total

        best = max(score([a for i, a in enumerate(anchors) if m >> i & 1]) for m in range(1, 1 << len(anchors)))
        assert score(chaining.chains(anchors)[0]) == pytest.approx(best)


def test_pieces_round_trip_and_weights(spark, odd_rows):
    model = pieces.load()
    rows = frame(spark, odd_rows)
    out = pieces.decode(pieces.encode(rows, model), model).collect()
    again = {(r.doc_id, r.text): r.ids for r in pieces.encode(rows.repartition(5), model).collect()}
    for r in out:
        assert r.decoded == (r.text or "") and again[(r.doc_id, r.text)] == r.ids
    assert pieces.encode(rows.limit(0), model).count() == 0
    # Draws of one word follow the weights of all ways to spell it.
    known = {model.text[i].decode("utf-8", "replace").replace(" ", "▁"): i for own in model.ids for i in own}

    def spellings(rest):
        if not rest:
            yield ()
        for n in range(1, len(rest) + 1):
            if rest[:n] in known:
                for tail in spellings(rest[n:]):
                    yield (known[rest[:n]], *tail)

    ways = list(spellings("▁there"))
    share = np.exp([sum(model.weights[i] for i in w) for w in ways])
    share /= share.sum()
    n = 40_000
    drawn = [tuple(x.tolist()) for x in pieces.encode_texts(["there"] * n, np.arange(n).astype(np.uint64), model)]
    for way, p in zip(ways, share):
        assert abs(drawn.count(way) / n - p) <= 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_ordinal_grades(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        kind = i % 3
        text = prose(rng, 40) + (" awful" if kind == 1 else "") + (" spam" * 30 if kind == 0 else "")
        rows.append((i, text, "a"))
        labels.append((i, int(kind > 0), int(kind == 1), "x"))
    marks = spark.createDataFrame(labels + [(None, 1, 0, "x"), (5000, 1, 1, "x"), (3, None, 0, "x")],
                                  "doc_id long, quality int, toxic int, text string")
    docs = frame(spark, rows)
    model = ordinal.fit(docs, marks.where("doc_id < 600 OR doc_id IS NULL"))
    assert list(model.cuts) == sorted(model.cuts)
    held = ordinal.grade(docs, model).where("doc_id >= 600").collect()
    assert sum(r.accepted == (r.doc_id % 3 == 2) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.p_top <= r.expected_grade <= 2 for r in held)
    odd = ordinal.grade(frame(spark, [(1, None, "a"), (2, "", "a"), (None, "x", None)]), model)
    assert odd.count() == 3
    empty = ordinal.fit(docs, marks.limit(0))
    assert ordinal.grade(docs.limit(5), empty).where("accepted").count() == 5


@pytest.mark.parametrize("sf,toxic,junk", [("sf0.001", 0.0, 0.05), ("sf0.01", 0.4, 0.8)])
def test_small_label_tables_give_weaker_models_not_none(spark, sf, toxic, junk):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    model = ordinal.fit(docs, labels.where("doc_id % 2 = 0"))
    assert len(model.codes) > 20
    held = labels.where("doc_id % 2 = 1").join(ordinal.grade(docs, model), "doc_id")
    shares = held.agg(*[F.avg(F.when(F.expr(c), F.col("accepted").cast("int"))).alias(n) for c, n in (
        ("toxic = 1", "toxic"), ("toxic = 0 AND quality = 0", "junk"), ("toxic = 0 AND quality = 1", "clean"))]).first()
    assert shares.toxic <= 1 - toxic and shares.junk <= 1 - junk and shares.clean >= 0.97


def test_labels_without_any_sign_give_the_shares(spark):
    rng = random.Random(3)
    rows = [(i, f"w{i}", "a") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    model = ordinal.fit(frame(spark, rows), labels)
    p_top = [r.p_top for r in ordinal.grade(frame(spark, rows), model).collect()]
    assert all(abs(p - 0.75) < 0.1 for p in p_top) or len(model.codes)


def test_many_small_sources_get_their_share(spark):
    """Sources far smaller than a block of the whole mix have blocks of their own."""
    rng = random.Random(12)
    rows = [(i, prose(rng, 40), "big") for i in range(40)] + [(100 + i, prose(rng, 5), f"s{i}") for i in range(30)]
    saved, mixing.BLOCKS = mixing.BLOCKS, 16
    try:
        got = mixing.mix(frame(spark, rows)).collect()
    finally:
        mixing.BLOCKS = saved
    for r in got:
        if r.source != "big":
            assert abs(r.taken - r.target) <= 0.5 + 1e-9


def test_line_runs_count_by_words_too(spark):
    rng = random.Random(21)
    long = [prose(rng, 60) for _ in range(3)]
    half = [prose(rng, 26) for _ in range(4)]
    rows = [(1, "\n".join(long[:2]), "a"), (2, "\n".join(long[:2]), "a"), (3, f"new\n{long[2]}\nend", "a"),
            (4, long[2], "a"), (5, "\n".join(half[:2]), "a"), (6, f"x\n{half[0]}\n{half[1]}\ny", "a"),
            (7, f"{half[0]}\nother", "a"), (8, "short line\nsecond", "a"), (9, "short line\nsecond", "a")]
    got = {r.doc_id: (r.text, r.n_removed) for r in drop_repeated_runs(frame(spark, rows)).collect()}
    assert got[2] == ("", 2) and got[4] == ("", 1) and got[6] == ("x\ny", 2)
    assert all(got[i][1] == 0 for i in (1, 3, 5, 7, 8, 9))


def test_mixing(spark, odd_rows):
    rng = random.Random(9)
    rows = odd_rows + [(1000 + i, prose(rng, rng.randint(1, 60)), rng.choice("aaaaaabc")) for i in range(300)]
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r.size for r in got)
    by = {}
    for r in got:
        own = by.setdefault(r.source, [0, r.source_size, r.target, 0])
        own[0] += r.taken
        own[3] += r.size
    total = sum(v[1] for v in by.values())
    assert sum(v[2] for v in by.values()) == pytest.approx(total)
    for taken, size, target, summed in by.values():
        assert size == summed and target <= 3 * size + 1e-9 and abs(taken - target) <= 0.02 * target + 2
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.mixed_documents(docs)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    mixed = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(words).alias("n")).collect()}
    want = {}
    for r in got:
        if r.taken:
            want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert mixed == want and out.columns == docs.columns
    order = mixing.mix_order(docs).orderBy("slot", "start").collect()
    summed, first = {}, {}
    for r in order:
        summed[r.doc_id] = summed.get(r.doc_id, 0) + r.words
        first.setdefault(r.doc_id, r.slot)
    assert summed == want
    for r in got:
        if r.doc_id is not None:
            assert r.first_slot == (first.get(r.doc_id) if r.taken else None) or r.doc_id < 1000
    # Low discrepancy: every tenth of the mix has each source near its share.
    by_source, cut = {r.doc_id: r.source for r in got}, max(r.slot for r in order) // 10 + 1
    whole = sum(r.words for r in order)
    for part in range(10):
        own = [r for r in order if r.slot // cut == part]
        for source, (taken, _, _, _) in by.items():
            here = sum(r.words for r in own if by_source[r.doc_id] == source)
            assert abs(here / max(1, sum(r.words for r in own)) - taken / whole) < 0.12
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None, None)])).first().taken == 0
