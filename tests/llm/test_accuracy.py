"""Learned operators by held-out figures on the driver's labels and planted
secrets."""

import os
import random

import pytest

from spanloom.llm import queries, secrets
from spanloom.llm.common import table
from tests.oracle import connect

WIDE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def wide():
    if not os.path.isdir(WIDE):
        pytest.skip("the driver's tables are not here")
    return WIDE


def test_toxicity_on_labels_that_were_not_learned_from(spark, wide):
    got = queries.op2_toxicity(spark, wide).where("held_out").toPandas().set_index("doc_id")
    labels = connect(wide).sql("SELECT doc_id, max(toxic) AS toxic FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id").df().set_index("doc_id")
    met = labels.join(got, how="inner")
    toxic, clean = met[met["toxic"] == 1], met[met["toxic"] == 0]
    assert len(toxic) >= 50 and len(clean) >= 500
    recall, kept = (toxic["predicted"] == 1).mean(), (clean["predicted"] == 0).mean()
    print(f"held out: recall {recall:.3f} of {len(toxic)}, clean kept {kept:.3f} of {len(clean)}")
    assert recall >= 0.85 and kept >= 0.95
    area = sum((clean["score"] < s).sum() + 0.5 * (clean["score"] == s).sum() for s in toxic["score"]) / len(toxic) / len(clean)
    assert area >= 0.95


def _planted(rng):
    """Random strings that no base pattern finds: other alphabets, lengths and
    generator than those that the model was trained with."""
    hexes, base32 = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = [(base32, 26), (hexes, 24), (letters + "0123456789", 20), (letters, 24), (letters + "0123456789-_", 43), (letters[:26] + "0123456789", 25), (letters + "0123456789+/", 40)]
    return ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet, n in kinds]


def test_planted_secrets_are_found_and_words_are_not(spark, wide):
    docs = table(spark, wide, "documents").where("doc_id % 10 = 0")
    models = secrets.fit(table(spark, wide, "documents").where("doc_id % 10 <> 0"))
    rng, rows = random.Random(77), []
    for r in docs.select("doc_id", "text").toPandas().itertuples():
        found, spans = [], [s for s in secrets.scan_text(r.text, models)[1] if s[1] == 3]
        ws = (r.text or "").split(" ")
        for p in _planted(rng):
            ws.insert(rng.randrange(len(ws) + 1), p)
            found.append(p)
        text = " ".join(ws)
        base, every = secrets.scan_text(text, models)
        hit = {text[a:b] for a, k, b in every if k == 3}
        # a planted string that a base pattern covers is found as well
        rows.append((len(spans), sum(p in hit or any(a <= text.find(p) < b for a, _, b in base) for p in found), len(found), len([h for h in hit if not any(p in h for p in found)])))
    false, caught, planted, others = map(sum, zip(*rows))
    print(f"planted {planted}: recall {caught / planted:.4f}, precision {caught / (caught + others):.4f}; {false} spans on {len(rows)} documents as they are")
    assert caught >= 0.97 * planted and others <= 0.01 * planted


def test_ordinary_identifiers_are_no_secrets(spark, wide):
    models = secrets.fit(table(spark, wide, "documents"))
    rng = random.Random(3)
    words = [w for w in connect(wide).sql("SELECT text FROM documents WHERE lang = 'en' LIMIT 50").fetchall() for w in w[0].split() if w.isalpha() and 3 <= len(w) <= 9]
    names = []
    for _ in range(2000):
        a, b, c = (rng.choice(words).lower() for _ in range(3))
        names.append(rng.choice([f"{a}_{b}_{c}_value", f"{a}{b.title()}{c.title()}Handler", f"{a}-{b}-{c}-{rng.randrange(100)}", f"{a}/{b}/{c}/index", f"{a}_{b}_{rng.randrange(2000, 2030)}_final", str(rng.randrange(10**16, 10**20))]))
    names = [n for n in names if len(n) >= secrets.MIN_LENGTH]
    assert sum(map(models.is_random, names)) <= 0.02 * len(names)
