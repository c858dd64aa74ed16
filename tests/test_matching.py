"""Token maps and audits against plain loops over the matching blocks, and the
matching itself against a table of all substrings."""

import random
import unicodedata

import pytest

from spanloom.functions import matching, text as tx
from spanloom.operators import align, audit

EXACT, CHANGED, REPEATED = align.EXACT, align.CHANGED, align.REPEATED


def longest(x, y):
    best = (0, 0, 0)
    for i in range(len(x)):
        for j in range(len(y)):
            n = 0
            while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
    return best


def blocks(x, y):
    """By the definition: longest first, then left and right of it."""
    i, j, n = longest(x, y)
    if not n:
        return []
    right = [(i + n + a, j + n + b, k) for a, b, k in blocks(x[i + n :], y[j + n :])]
    out = []
    for a, b, k in [*blocks(x[:i], y[:j]), (i, j, n), *right]:
        if out and out[-1][0] + out[-1][2] == a and out[-1][1] + out[-1][2] == b:
            out[-1] = (*out[-1][:2], out[-1][2] + k)
        else:
            out.append((a, b, k))
    return out


@pytest.mark.parametrize("small", [0, 40, 8_000])
def test_blocks_against_the_definition(monkeypatch, small):
    monkeypatch.setattr(matching, "_SMALL", small)
    rng = random.Random(small)
    for k in range(150):
        letters = ["ab", "abcdefgh", "aé日\U0001d4b3b"][k % 3]
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        y = "".join(c for c in x if rng.random() > 0.15) + x[: rng.randint(0, 9)] if k % 2 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert matching.matching_blocks(x, y) == blocks(x, y)
    assert matching.matching_blocks("", "") == matching.matching_blocks("a", "") == []


def test_long_texts_match_quickly():
    rng = random.Random(1)
    x = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    y = x[:20_000] + "?" + x[20_003:45_000] + "!!" + x[45_000:]
    found = matching.matching_blocks(x, y)
    assert all(x[i : i + n] == y[j : j + n] for i, j, n in found) and sum(n for _, _, n in found) == 59_997
    assert (20_003, 20_001, 24_997) in found


def lexical(c):
    return c == "'" or unicodedata.category(c)[0] in "LN"


def kind_of(c):
    if lexical(c):
        return "unmapped_lexical_characters"
    if c.isspace():
        return "untimed_whitespace"
    return "untimed_punctuation" if unicodedata.category(c)[0] == "P" else "untimed_other_removed_character"


def plain_owners(text, tokens):
    """(status of each token, owner of each character of the text)."""
    letters = [i for i, c in enumerate(text) if lexical(c)]
    x, y = "".join(text[i] for i in letters), "".join(tokens)
    found, status, owner, at = blocks(x, y), [], [None] * len(text), 0
    count = lambda t, part: sum(t.startswith(part, i) for i in range(len(t)))
    for k, token in enumerate(tokens):
        held = [b for b in found if b[1] <= at and at + len(token) <= b[1] + b[2]]
        if not held:
            status.append(CHANGED)
        else:
            i, j, n = held[0]
            if x != y and (count(x, x[i : i + n]) > 1 or count(y, x[i : i + n]) > 1):
                status.append(REPEATED)
            else:
                status.append(EXACT)
                for m in range(len(token)):
                    owner[letters[i + at - j + m]] = k
        at += len(token)
    return status, owner


TEXTS = [
    ("rain, then sun", ["rain", "then", "sun"]),
    ("la la la land", ["la", "land"]),
    ("it's 4.5% up!", ["it's", "45", "up"]),
    ("\U0001f600 olá, mundo\u3000novo", ["olá", "mund", "novo"]),
    ("abcabc", ["abc"]),
    ("", ["x"]),
    ("...!? ", []),
    ("東京タワーは高い。", ["東京", "タワ", "は", "高い"]),
    ("tab\tand\u00a0space\x1cend", ["tab", "and", "space", "end"]),
]


def cases():
    rng, out = random.Random(6), list(TEXTS)
    for _ in range(40):
        ws = ["".join(rng.choice("abcde'é") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 25))]
        text = "".join(w + rng.choice([" ", ", ", "-", "\n", " + "]) for w in ws)
        out.append((text, [w for w in (w if rng.random() > 0.2 else w[:-1] for w in ws) if w]))
    return [(i, t, ws) for i, (t, ws) in enumerate(out)]


def test_token_map_against_a_plain_loop(spark):
    rows = cases()
    df = spark.createDataFrame([*rows, (900, None, ["a"]), (901, "a", None)], "rec int, text string, words array<string>")
    tokens, pieces, met = {}, {}, {r["rec"]: r for r in align.token_coverage(df).collect()}
    for r in align.token_map(df).orderBy("rec", "idx").collect():
        tokens.setdefault(r["rec"], []).append(r)
    for r in align.token_map(df, pieces=True).orderBy("rec", "pos").collect():
        pieces.setdefault(r["rec"], []).append(r)
    assert not {900, 901} & (set(tokens) | set(pieces) | set(met))
    for rec, text, words in rows:
        status, owner = plain_owners(text, words)
        got = tokens.get(rec, [])
        assert [r["status"] for r in got] == status and [r["token"] for r in got] == words, text
        for k, r in enumerate(got):
            assert [i for a, b in r["spans"] for i in range(a, b)] == [i for i, o in enumerate(owner) if o == k]
            assert (r["raw_a"], r["raw_b"]) == ((r["spans"][0]["a"], r["spans"][-1]["b"]) if r["mapped"] else (None, None))
        want = []
        for i, c in enumerate(text):
            one = ("mapped_lexical_characters" if owner[i] is not None else kind_of(c), owner[i])
            if want and want[-1][0] == one:
                want[-1][1].append(i)
            else:
                want.append((one, [i]))
        assert [((p["kind"], p["idx"]), list(range(p["a"], p["b"]))) for p in pieces.get(rec, [])] == want, text
        assert "".join(p["piece"] for p in pieces.get(rec, [])) == text and [p["pos"] for p in pieces.get(rec, [])] == list(range(len(want)))
        mapped = sum(o is not None for o in owner)
        assert (met[rec]["mapped_lexical_characters"], met[rec]["original_lexical_characters"]) == (mapped, sum(map(lexical, text)))
        assert met[rec]["all_tokens_mapped"] == all(s == EXACT for s in status)


def test_empty_tokens_are_errors(spark):
    for words in (["a", ""], ["a", None]):
        with pytest.raises(Exception, match="null or empty"):
            align.token_map(spark.createDataFrame([(1, "a", words)], "rec int, text string, words array<string>")).collect()


def units(text, at=0.0):
    return [(c, at + i, at + i + 1.0) for i, c in enumerate(text)]


def audited(spark, pairs, terms=()):
    df = spark.createDataFrame([(i, u, t) for i, (u, t) in enumerate(pairs)], "rec int, units array<struct<text:string,start:double,end:double>>, text string")
    out = [[] for _ in pairs]
    for r in audit.audit(df, list(terms)).orderBy("rec", "pos").collect():
        out[r["rec"]].append(r)
    return out


def test_audit_scenarios(spark):
    got = audited(
        spark,
        [
            (units("red", 30.0), "rod"), (units("rd", 30.0), "red"), (units("ＸＹＺ７８９"), "XYZ789"), (units("hello hello"), "hello"), (units("7.25"), "725"), (units("-9"), "9"), (units("80%"), "80"),
            (units("head" + "q" * 5), "head" + "".join(chr(0x4E00 + 3 * i) for i in range(21))), (units("head" + "q" * 5), "head" + "".join(chr(0x4E00 + 3 * i) for i in range(20))), (units("head" + "q" * 6), "head" + "".join(chr(0x4E00 + 3 * i) for i in range(21))),
            ([("open", 1.0, 2.0), ("ing", float("nan"), 3.0), ("time", 2.0, float("inf"))], "opening times"), ([("back", 5.0, 6.0), ("wards", 4.0, 7.0)], "backwards"), (None, "alone"), ([], None),
        ],
    )
    first = [r for r in got[0] if r["kind"] == "difference"]
    assert [(r["start"], r["end"], tuple(r["ref_span"]), r["own_text"]) for r in first] == [(31, 32, (1, 2), "o")]
    assert [r["start"] for r in got[1] if r["kind"] == "difference"] == [None]
    assert [r["kind"] for r in got[2]] == ["anchor"]
    assert not [r for r in got[3] if r["kind"] == "anchor"]
    for k in (4, 5, 6):
        assert any("number_or_numeric_character_difference" in r["signals"] for r in got[k])
    assert [any("potential_substantive_omission" in r["signals"] for r in got[k]) for k in (7, 8, 9)] == [True, False, False]
    assert [r["timing"] for r in got[10] if r["kind"] == "anchor"] == ["missing_or_invalid_source_time"]
    assert [r["timing"] for r in got[11] if r["kind"] == "anchor"] == ["non_monotonic_source_times"]
    assert [(r["kind"], r["own_text"]) for r in got[12]] == [("difference", "alone"), ("own_gap", "alone")] and got[13] == []


def test_audit_against_a_plain_loop(spark):
    rng = random.Random(9)
    words = ["alpha", "beta 12", "gamma", "3.5", "delta", "ない", "kappa", "theta", "mu"]
    pairs = []
    for _ in range(30):
        ws = [rng.choice(words) for _ in range(rng.randint(1, 12))]
        other = [w for w in ws if rng.random() > 0.2]
        other.insert(rng.randint(0, len(other)), rng.choice(words))
        pairs.append(([(w + " ", float(i), i + 1.0) for i, w in enumerate(ws)], " ".join(other)))
    for (us, own), rows in zip(pairs, audited(spark, pairs, ["gamma"])):
        ref = "".join(u[0] for u in us)
        x, y = tx.normalize(ref)[0], tx.normalize(own)[0]
        places = {"ref": tx.normalize(ref)[1], "own": tx.normalize(own)[1]}
        sure = {"ref": [False] * len(x), "own": [False] * len(y)}
        anchors, rejected = [], 0
        for i, j, n in blocks(x, y):
            part = x[i : i + n]
            if n >= 4 and sum(x.startswith(part, k) for k in range(len(x))) == sum(y.startswith(part, k) for k in range(len(y))) == 1:
                anchors.append((i, j, n))
                sure["ref"][i : i + n] = sure["own"][j : j + n] = [True] * n
            else:
                rejected += 1
        found = [r for r in rows if r["kind"] == "anchor"]
        assert [(r["ref_norm"]["a"], r["own_norm"]["a"], r["ref_norm"]["b"] - r["ref_norm"]["a"]) for r in found] == anchors
        assert [r["id"] for r in found] == list(range(len(anchors))) and sum(r["kind"] == "rejected" for r in rows) == rejected
        for side, raw in (("ref", ref), ("own", own)):
            runs, k = [], 0
            while k < len(sure[side]):
                m = k
                while m < len(sure[side]) and not sure[side][m]:
                    m += 1
                if m > k:
                    runs.append((places[side][k][0], places[side][m - 1][1]))
                k = m + 1
            gaps = [r for r in rows if r["kind"] == f"{side}_gap"]
            assert [tuple(r[f"{side}_span"]) for r in gaps] == runs and [r[f"{side}_text"] for r in gaps] == [raw[a:b] for a, b in runs]
        for r in rows:
            if r["kind"] == "difference":
                (c, d), (a, b) = r["own_norm"], r["ref_norm"]
                assert r["before"] == max((k for k, (_, j, n) in enumerate(anchors) if j + n <= c), default=None)
                assert r["after"] == min((k for k, (_, j, _) in enumerate(anchors) if j >= d), default=None)
                for signal, terms in (("critical_term_difference", ["gamma"]), ("negation_difference_candidate", tx.NEGATIONS)):
                    touched = any(t.startswith(w, s) and (s < lo < s + len(w) if lo == hi else lo < s + len(w) and hi > s) for t, lo, hi in ((x, a, b), (y, c, d)) for w in terms for s in range(len(t)))
                    assert (signal in r["signals"]) == touched
            if r["kind"] in ("anchor", "difference"):
                at, met = 0, []
                for t, s, e in us:
                    if at < r["ref_span"]["b"] and at + len(t) > r["ref_span"]["a"]:
                        met.append((s, e))
                    at += len(t)
                assert (r["start"], r["end"]) == ((met[0][0], met[-1][1]) if met else (None, None))
