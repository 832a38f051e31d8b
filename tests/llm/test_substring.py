import random
import re
import zlib

from groundsearch.llm import substring as S


def words(rng, n):
    return [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice(["na", "ra", "lo"]) + rng.choice("xyzwq") for _ in range(n)]


def raw_units(text):
    """The contract in plain Python: (first word, words, normalised words) of lines under WINDOW words and of anchored windows."""
    lines, flat = [], []
    for line in text.split("\n"):
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in re.findall(r"[^\x20\x09-\x0D]+", line)]
        if 0 < len(w) < S.WINDOW:
            lines.append((len(flat), len(w), " ".join(w)))
        flat += w
    out = []
    for i in range(len(flat) - S.WINDOW + 1):
        hashes = [seed_hash(flat[j : j + S.SEED]) for j in range(i, i + S.WINDOW - S.SEED + 1)]
        if hashes.index(min(hashes)) % S.STEP == 0:
            out.append((i, S.WINDOW, " ".join(flat[i : i + S.WINDOW])))
    return sorted(out + lines, key=lambda u: (u[0], -u[1])), flat


def seed_hash(words):
    m, x = (1 << 64) - 1, 0
    for w in words:
        h = (zlib.crc32(w.encode()) + 1) * 0x9E3779B97F4A7C15 & m
        x = (x * 0xC2B2AE3D27D4EB4F + (h ^ h >> 32)) & m
    x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 & m
    return x ^ x >> 29


def brute(rows, min_words=S.MIN_WORDS):
    """Over (doc_id, text): the texts that stay, by dictionaries over all units, with removal by marking words."""
    order = sorted({(d is None, d or 0, t or "") for d, t in rows})
    parsed = {t: raw_units(t) for *_, t in order}
    owner, first = {}, {}
    for none, d, t in order:
        owner.setdefault(t, (none, d))
        for u in parsed[t][0]:
            first.setdefault(u[2], (none, d))
    out = []
    for d, t in rows:
        if not t:
            out.append(t)
            continue
        me, (unit, flat) = (d is None, d or 0), parsed[t]
        gone = [False] * len(flat)
        if owner[t] != me:
            gone = [True] * len(flat)
        else:
            stays = {}
            for at, n, words in unit:
                if first[words] == me and words not in stays:
                    stays[words] = at
                elif first[words] != me or at >= stays[words] + n:
                    gone[at : at + n] = [True] * n
        spans, k = [], 0
        place = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
        while k < len(flat):
            e = k
            while e < len(flat) and gone[e]:
                e += 1
            if e - k >= min_words:
                spans.append((place[k][0], place[e - 1][1]))
            k = max(e, k + 1)
        out.append(cut(t, spans))
    return out


def cut(text, spans):
    """Without the spans and the white space after each, where some stands before it too."""
    kept, at = "", 0
    for s, e in spans:
        kept += text[at:s]
        at = e
        if s == 0 or text[s - 1] in " \t\n\v\f\r":
            while at < len(text) and text[at] in " \t\n\v\f\r":
                at += 1
    kept += text[at:]
    return kept.rstrip(" \t\n\v\f\r") if spans and at >= len(text) else kept


def make(rng):
    passage = " ".join(words(rng, 60))
    line = " ".join(words(rng, 30))
    rows = []
    for i in range(40):
        w = words(rng, rng.randint(0, 200))
        for k in range(20, len(w), 37):
            w[k] += ".\n"
        if i % 3 == 0:
            w.insert(rng.randint(0, len(w)), passage)
        t = " ".join(w)
        if i % 5 == 0:
            t += "\n" + line.upper() + "\n"
        rows.append((i, t))
    return rows, passage, line


def test_planted_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(1)
    rows, passage, line = make(rng)
    rows += [(None, passage), (100, None), (101, ""), (102, rows[7][1]), (102, rows[7][1]), (103, " \n ")]
    got = S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", S.F.lit(1))).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(d), str(t)) for (d, _), t in zip(rows, brute(rows), strict=True))
    text = {r.doc_id: r.text for r in got if r.doc_id != 102}
    original = dict(rows)
    for i in range(1, 40):
        if i % 3 == 0:
            assert passage not in " ".join(text[i].split())
            left = [w for w in passage.split() if w in text[i].split()]
            assert len(left) < 45
        elif i % 5:
            assert text[i] == original[i]
        if i % 5 == 0:
            assert line.upper() not in text[i]
    assert passage in text[0] and line.upper() in text[0]
    for r in got:
        if r.doc_id is not None and r.doc_id < 100 and r.removed:
            cut = " ".join(original[r.doc_id][s.start : s.stop] for s in r.removed)
            assert sorted((cut + text[r.doc_id]).split()) != [] and len(cut.split()) + len(text[r.doc_id].split()) == len(original[r.doc_id].split())


def test_repeated_passages_have_common_units_up_to_their_ends():
    """Of every passage of WINDOW + STEP - 1 words and more, all but STEP - 1 words at either end, whatever stands around it."""
    rng = random.Random(2)
    for _ in range(200):
        p = words(rng, rng.randint(S.WINDOW + S.STEP - 1, 90)) if rng.random() < 0.8 else (words(rng, 3) * 40)[: S.WINDOW + 20]
        found = []
        for _ in range(2):
            before = words(rng, rng.randint(0, 60))
            w = S.Words(" ".join([*before, *p, *words(rng, 50)]).encode())
            found.append({int(i) - len(before): d for i, d in zip(w.first, w.digests(list(range(len(w.first)))), strict=True) if 0 <= i - len(before) <= len(p) - S.WINDOW})
        assert found[0] == found[1]
        assert min(found[0]) < S.STEP and len(p) - S.WINDOW - max(found[0]) < S.STEP
        assert all(b - a <= S.STEP for a, b in zip(sorted(found[0]), sorted(found[0])[1:], strict=False))


def test_offsets_are_code_points_and_long_texts_are_whole(spark):
    rng = random.Random(3)
    p = " ".join(w + "é" for w in words(rng, 70))
    big = " ".join(words(rng, 30000)) + " " + p
    got = {r.doc_id: r for r in S.dedup_substrings(spark.createDataFrame([(1, "ü " + p), (2, big)], "doc_id long, text string")).collect()}
    (span,) = got[2].removed
    assert big[span.start : span.stop] in p and span.stop - span.start > len(p) // 2 and got[1].n_removed == 0
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.text) for r in S.op6_substring(spark, sf).collect())
    assert got == sorted((d, t) for (d, _), t in zip(rows, brute(rows), strict=True))


def test_passages_in_the_middle_of_lines_go_but_for_a_few_words(spark):
    rng = random.Random(4)
    rows, lost = [], []
    for n in range(60):
        p = words(rng, 30 + n)
        for d in (2 * n, 2 * n + 1):
            left, right = words(rng, 30), words(rng, 30)
            rows.append((d, " ".join([*left, *p[:20], *p[20:]]) + ("\n" if d % 4 else " ") + " ".join(right)))
        lost.append((len(p), len(" ".join([*left, *p, *right]).split()) - 60))
    rows += [(500, "same " * 100), (501, "x y")]
    got = {r.doc_id: r.text for r in S.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n in range(60):
        assert got[2 * n] == rows[2 * n][1]
        left = len(got[2 * n + 1].split()) - 60
        assert left == 30 + n if 30 + n < S.WINDOW else left <= 2 * (S.STEP - 1) if 30 + n >= S.WINDOW + S.STEP - 1 else left <= 30 + n
    assert len(got[500].split()) < 2 * S.WINDOW and got[501] == "x y"


def left_by_all_windows(rows):
    """Over (doc_id, words) of different texts: the words that stay if all windows of WINDOW words that came before go, whatever their place."""
    seen, out = set(), {}
    for d, w in sorted(rows):
        windows = [tuple(w[i : i + S.WINDOW]) for i in range(len(w) - S.WINDOW + 1)]
        gone, here = set(), {}
        for i, x in enumerate(windows):
            if x in seen or i >= here.setdefault(x, i) + S.WINDOW:
                gone.update(range(i, i + S.WINDOW))
        seen.update(windows)
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out


def test_repeated_passages_of_a_window_and_more_go_whole(spark):
    rng, rows, fresh = random.Random(5), [], iter(range(10**6))
    for n in range(60):
        p = words(rng, S.WINDOW + n % 30)
        for d in (2 * n, 2 * n + 1):
            rows.append((d, [f"u{next(fresh)}" for _ in range(rng.randint(0, 70))] + p + [f"u{next(fresh)}" for _ in range(rng.randint(0, 70))]))
    got = {r.doc_id: r for r in S.dedup_substrings(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()}
    for d, w in rows:
        assert got[d].text.split() == (w if d % 2 == 0 else [x for x in w if x[0] == "u" and x[1:].isdigit()])
        assert got[d].n_removed == (d % 2) * (d // 2 % 30 + 1)


def test_windows_of_passages_that_overlap_in_many_ways(spark):
    rng, rows = random.Random(6), []
    source = words(rng, 400)
    for d in range(80):
        w = []
        for _ in range(rng.randint(1, 4)):
            s = rng.randint(0, 340)
            part = source[s : s + rng.randint(20, 120)]
            w += [*words(rng, rng.randint(0, 9)), *part, *(part if rng.random() < 0.3 else []), *(words(rng, rng.randint(1, 3)) * 30 if rng.random() < 0.2 else [])]
        rows.append((d, w))
    want = left_by_all_windows(rows)
    got = S.dedup_substrings(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(7)).collect()
    # a text of fewer than WINDOW words is a line, which goes where another text is that line
    assert {r.doc_id: r.text.split() for r in got if len(dict(rows)[r.doc_id]) >= S.WINDOW} == {d: w for d, w in want.items() if len(dict(rows)[d]) >= S.WINDOW}
