import random
import re

import numpy as np

from marlstone.llm import common, substring

SCHEMA = "doc_id long, text string, n_removed string, cut_result int, spans_to_cut int"


def run(spark, rows):
    got = substring.dedup_substrings(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA))
    assert got.columns == ["doc_id", "text", "cut_result", "spans_to_cut", "n_sentences", "n_removed"]
    return got.collect()


def bounds(words, text):
    """Word positions at which sentences, and parts of long ones, begin, by plain loops."""
    begins = [k for k, (at, _) in enumerate(words) if k == 0 or re.search(r"[.!?][)\"”]?$", words[k - 1][1]) or "\n" in text[words[k - 1][0] + len(words[k - 1][1]) : at]]
    out = set(begins)
    for s, e in zip(begins, [*begins[1:], len(words)], strict=True):
        if e - s > substring.PLAIN:
            hashes = pair_hashes([w for _, w in words[s:e]])
            for k in range(e - s - substring.WINDOW + 1):
                window = hashes[k : k + substring.WINDOW]
                out |= {s + k + j for j, x in enumerate(window) if x == min(window)}
    return [*sorted(out), len(words)]


def pair_hashes(words):
    """The order among word pairs, which no rule but the hash gives."""
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    h = common.words_of(data, np.array([0, len(data)]))[2]
    return [int(x) for x in common.mix64(h + np.append(h[1:], np.uint64(0)) * common._MULT[1])]


def brute(rows):
    """By plain strings: each text without repeated runs of sentences, any run of two with 15 words or more."""
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda x: x[0]):
        words = [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        b = bounds(words, t or "") if words else [0]
        gone = set()
        for s in range(len(b) - 1):
            for e in range(s + 2, len(b)):
                if b[e] - b[s] >= 15 and seen.setdefault(tuple(w.lower() for _, w in words[b[s] : b[e]]), (i, t, s))[:] != (i, t, s):
                    gone |= set(range(b[s], b[e]))
        at = [0] + [w[0] for w in words[1:]] + [len(t or "")]
        out.append((i, t if not gone else "".join(t[at[k] : at[k + 1]] for k in range(len(words)) if k not in gone)))
    return out


def sentence(r):
    return " ".join(r.choice(["alpha", "beta", "gamma", "été", "delta"]) + r.choice("abcdefgh") for _ in range(r.randint(3, 12))).capitalize() + r.choice([".", "!", "?", '."', "!)"])


def test_matches_brute_force(spark):
    r = random.Random(1)
    shared = [" ".join(sentence(r) for _ in range(8)) for _ in range(3)]
    rows = []
    for i in range(40):
        parts = [sentence(r) for _ in range(r.randint(0, 9))]
        if i % 3 == 0:
            parts.insert(r.randint(0, len(parts)), "It begins in a line.\n" + shared[i % 9 // 3])
        if i % 5 == 0:
            parts.insert(0, "Short line that all share.")
        rows.append((i, r.choice([" ", "\n"]).join(parts)))
    want = brute(rows)
    got = {x.doc_id: x.text for x in run(spark, rows)}
    assert [(i, got[i]) for i, _ in rows] == want
    assert sum(got[i] != t for i, t in rows) > 5
    # Every passage stays once, and all texts that share nothing long stay as they are.
    for p in shared:
        assert sum(p in t for t in got.values()) == 1


def test_short_runs_of_sentences_go(spark):
    r = random.Random(11)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    shared = " ".join(f"{words(12)}." for _ in range(3))
    rows = [(i, f"{words(8)}. {shared} {words(9)}. {words(10)}.") for i in range(3)]
    got = {x.doc_id: (x.text, x.n_removed) for x in run(spark, rows)}
    assert got[0] == (rows[0][1], 0) and all(got[i] == (rows[i][1].replace(shared + " ", ""), 3) for i in (1, 2))
    # Under the floor, and lone sentences, stay; whole sentences go or stay.
    short, lone = f"{words(6)}. {words(7)}.", f"{words(12)}."
    rows = [(i, f"{words(8)}. {part} {words(9)}.") for i, part in enumerate([short, short, lone, lone])]
    assert [(x.text, x.n_removed) for x in sorted(run(spark, rows), key=lambda x: x.doc_id)] == [(t, 0) for _, t in rows]


def test_texts_of_one_id_keep_their_own_words(spark):
    r = random.Random(12)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    prose = lambda n: " ".join(f"{words(10)}." for _ in range(n))
    passage, x, y = prose(6), prose(18), prose(3)
    got = [(row.doc_id, row.text) for row in run(spark, [(0, passage), (1, x), (1, f"{passage} {y}")])]
    assert sorted(got) == sorted([(0, passage), (1, x), (1, y)])
    # What two texts of one id share stays in one of them.
    got = [row.text for row in run(spark, [(1, f"{passage} {x}"), (1, f"{passage} {y}")])]
    assert sorted(got, key=len) in ([y, f"{passage} {x}"], [f"{passage} {y}", x])


def test_names_and_nouns_begin_no_sentence(spark):
    r = random.Random(8)
    nouns = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)).capitalize() for _ in range(n))
    shared = nouns(14)  # in the middle of sentences, under the length of a span
    rows = [(i, f"Wir sehen {nouns(5)} {shared} {nouns(5)}. Und {nouns(4)}.") for i in range(3)]
    assert [(x.doc_id, x.text, x.n_sentences, x.n_removed) for x in run(spark, rows)] == [(i, t, 2, 0) for i, t in rows]
    # Marks of other scripts end sentences too, and quotes may close after them.
    assert [len(x) for x in _sentences("Er kam. Sie ging! „Ja?“ 文。 End… \"So.\" he said (yes.) and")] == [2, 2, 1, 1, 1, 1, 3, 1]


def _sentences(text):
    import numpy as np

    data = np.frombuffer(text.encode(), dtype=np.uint8)
    starts, _, _, sent, _ = substring.sentences(data, np.array([0, len(data)]))
    return [list(range(a, b)) for a, b in zip(sent[:-1], sent[1:], strict=True)]


def test_edges(spark):
    long = " ".join(["word%d" % k for k in range(60)]) + "."
    rows = [(1, long), (2, "Before it. " + long.capitalize()), (3, None), (4, ""), (None, long), (5, "Few words."), (6, "Few words."), (7, long), (7, long)]
    got = [(x.doc_id, x.text, x.n_removed) for x in run(spark, rows)]
    assert (1, long, 0) in got and (2, "Before it. ", 1) in got and (3, None, 0) in got and (4, "", 0) in got
    assert (None, long, 0) in got and (5, "Few words.", 0) in got and (6, "Few words.", 0) in got
    assert got.count((7, "", 1)) == 2
    assert run(spark, []) == []
    # Repeated rows are one document: nothing of them is lost.
    again = [(1, long), (1, long)]
    assert [x.text for x in run(spark, again)] == [long, long]


def test_repeats_without_sentence_limits(spark):
    r = random.Random(4)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rows, passages = [], []
    for n in [*range(51, 81), *range(51, 81)]:
        # Whole, or with sentences of its own somewhere.
        passage = words(n).split()
        for k in r.sample(range(n), r.choice([0, 0, 1, 3])):
            passage[k] += "."
        passages.append(" ".join(passage))
        for _ in range(2):
            rows.append((len(rows), f"{words(r.randint(1, 30))} {passages[-1]} {words(r.randint(1, 30))}"))
    # Repeats of a few words stay.
    short = [words(n) for n in (6, 8, 10, 14)]
    rows += [(1000 + i, f"{words(9)} {short[i // 2]} {words(9)}") for i in range(8)]
    got = {x.doc_id: (x.text, x.n_removed) for x in run(spark, rows)}
    for i, p in enumerate(passages):
        assert got[2 * i] == (rows[2 * i][1], 0)
        text, n = got[2 * i + 1]
        before, after = rows[2 * i + 1][1].split(p)
        assert text.startswith(before) and text.endswith(after) and n >= 1
        assert len(text[len(before) : len(text) - len(after)].split()) <= len(p.split()) - 15
    assert all(got[i] == (t, 0) for i, t in rows if i >= 1000)
    assert [(i, got[i][0]) for i, _ in rows] == brute(rows)
