import itertools

import numpy as np
import pytest

import pii_sentences
from tessellar.llm import pii, pii_table


@pytest.fixture(scope="module")
def model():
    return pii.default_model()


@pytest.fixture(scope="module")
def decoder(model):
    return pii.Decoder(model)


def found(text, decoder):
    return [(k, text[a:b]) for _, k, a, b in pii.mentions([text], decoder)]


def scored(rows, decoder):
    """Recall and precision of whole mentions, by kind and over all."""
    hit, said, true = (dict.fromkeys(pii.KINDS, 0) for _ in range(3))
    got = {}
    for d, k, a, b in pii.mentions([t for t, _ in rows], decoder):
        got.setdefault(d, set()).add((a, b, k))
    for d, (_, spans) in enumerate(rows):
        mine = got.get(d, set())
        for k in pii.KINDS:
            a, b = {s for s in mine if s[2] == k}, {s for s in spans if s[2] == k}
            hit[k], said[k], true[k] = hit[k] + len(a & b), said[k] + len(a), true[k] + len(b)
    return {k: (hit[k] / true[k], hit[k] / max(said[k], 1)) for k in pii.KINDS} | {"all": (sum(hit.values()) / sum(true.values()), sum(hit.values()) / sum(said.values()))}


def test_sentences_written_by_hand(decoder):
    """Over 200 mentions in wording that no training sentence has."""
    rows = pii_sentences.marked()
    assert sum(len(s) for _, s in rows) >= 200
    by_kind = scored(rows, decoder)
    assert min(r for r, _ in by_kind.values()) >= 0.9 and by_kind["all"][1] >= 0.9, by_kind


def test_templates_held_out_whole():
    """Trained without every fifth template and sentence, measured on those alone."""
    fit, held = ([t for k, t in enumerate(pii_table.TEMPLATES) if bool(k % 5) is keep] for keep in (True, False))
    quiet, held_quiet = ([t for k, t in enumerate(pii_table.NEGATIVES) if bool(k % 5) is keep] for keep in (True, False))
    model = pii.train(pii_table.labelled(22, 11, fit, quiet))
    by_kind = scored(pii_table.labelled(10, 77, held, held_quiet, 10), pii.Decoder(model))
    print(by_kind)
    assert by_kind["all"][0] >= 0.9, by_kind


def test_cues_reach_over_words_but_not_over_texts():
    cues, breaks = np.array([0, 1, 0, 0, 0, 0, 2, 0, 0, 0, 0]), np.array([False] * 8 + [True] + [False] * 2)
    assert pii.announced(cues, breaks).tolist() == [0, 0, 4, 4, 4, 8, 8, 9, 0, 0, 0]


def test_without_vocabularies():
    words = pii.lexicon(["/nowhere"])
    assert words.proper == frozenset() and "the" in words.ordinary


def test_the_model_is_kept(spark, monkeypatch):
    first = pii.stored_model(spark)
    monkeypatch.setattr(pii, "_KEPT", {})
    monkeypatch.setattr(pii, "default_model", lambda: pytest.fail("trained again"))
    again = pii.stored_model(spark)
    assert again is not first and (again.weights == first.weights).all()


SENTENCES = [
    ("Thanks to Marguerite Ashdown for the plots.", [("person", "Marguerite Ashdown")]),
    ("Prof. Ashdown signed off on the lipid ratio.", [("person", "Ashdown")]),
    ("Write to m.ashdown@phys.example.org or +44 20 7946 0018.", [("email", "m.ashdown@phys.example.org"), ("phone", "+44 20 7946 0018")]),
    ("The Ashdown thermostat with a friction of 2.1 gave the cleanest density profile.", []),
    ("rsync rep12@node7:/scratch/x/rep3 stalled twice, nothing lost.", []),
    ("Run key 1234-5678-90 belongs to the third sweep; do not mix it with 1111-2222-33.", []),
    ("", []),
]


@pytest.mark.parametrize(("text", "mentions"), SENTENCES)
def test_sentences(decoder, text, mentions):
    assert found(text, decoder) == mentions


def test_address_across_lines(decoder):
    text = "The hardware key went by courier to 12 Juniper Lane, Apt. 3B\nNorvale 00123. Volume shrinks by 3.3 percent."
    assert found(text, decoder) == [("address", "12 Juniper Lane, Apt. 3B\nNorvale 00123")]


def test_decoding_is_the_best_path(decoder):
    """Viterbi over the stretches that are left equals the best of all label sequences."""
    t = decoder.model.transitions
    for text in ("Ask Ruth Hale", "ring 555-010-1234 x9", "a\nb"):
        list(pii.mentions([text], decoder))
        types = np.array([decoder.type_of(w) for w in pii.TOKEN.findall(text)] + [0])
        decoder.grow()
        emit = decoder.emissions(types)
        n = min(len(types) - 1, 4)

        def score(path, emit=emit, n=n):
            full = [0, *path, 0]
            return sum(emit[i, y] for i, y in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(full))

        if n == len(types) - 1:
            best = max(itertools.product(range(pii.L), repeat=n), key=score)
            assert decoder.label(types)[:n].tolist() == list(best)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    part = [(rng.integers(0, 9, (n, 2)), rng.integers(0, pii.L, n)) for n in (3, 1, 4)]
    w, t = rng.normal(size=(10, pii.L)), rng.normal(size=(pii.L + 1, pii.L))

    def loss(w, t):
        total = 0.0
        for ids, y in part:
            emit = w[ids].sum(1)
            a = emit[0] + t[pii.L]
            for s in range(1, len(y)):
                a = np.log(np.exp(a[:, None] + t[: pii.L]).sum(0)) + emit[s]
            total += np.log(np.exp(a).sum()) - emit[np.arange(len(y)), y].sum() - t[pii.L, y[0]] - t[y[:-1], y[1:]].sum()
        return total

    gw, gt = pii._gradient(part, w, t, 10)
    for x, g, at in ((w, gw, (4, 2)), (w, gw, (0, 5)), (t, gt, (1, 2)), (t, gt, (pii.L, 3))):
        up, down = x.copy(), x.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        numeric = (loss(up, t) - loss(down, t) if x is w else loss(w, up) - loss(w, down)) / 2e-5
        assert abs(numeric - g[at]) < 1e-4


def test_redaction_leaves_the_rest(spark, decoder):
    rows = [(1, "Thanks to Marguerite Ashdown for the plots.\n\tKept  as is."), (2, ""), (3, None), (4, "x " * 300_000 + "Thanks to Marguerite Ashdown for it."), (1, "Thanks to Marguerite Ashdown for the plots.\n\tKept  as is.")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, kind string")
    out = [tuple(r) for r in pii.redact(df).collect()]
    assert out[0] == out[4] == (1, "Thanks to [PERSON] for the plots.\n\tKept  as is.")
    assert out[1:3] == [(2, ""), (3, None)] and out[3][1] == "x " * 300_000 + "Thanks to [PERSON] for it."
    places = pii.find(df).collect()
    assert sorted((r["doc_id"], r["kind"]) for r in places) == [(1, "person"), (1, "person"), (4, "person")]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty).collect() == [] and pii.redact(empty).collect() == []
