import random

import numpy as np
import pyarrow as pa

from evidencelake.llm import neardup, passages, syncmers
from evidencelake.llm.components import components

from .conftest import prose


def edited(text, seed, share):
    draw = random.Random(seed)
    return " ".join(f"x{draw.randrange(10**6)}" if draw.random() < share else w for w in text.split())


def brute_classes(texts):
    sets = []
    for text in texts:
        words = (text or "").split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def planted():
    texts = []
    for group in range(6):
        base = prose(100 + group, 150 + 40 * group)
        texts += [base, base, *(edited(base, 10 * group + k, 0.004 * k) for k in range(12))]
    return texts + [prose(900 + i, 90) for i in range(20)] + ["one two", "one two", "one three", "", None, " \n"]


def test_classes_equal_brute_force(make):
    texts = planted()
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(make(texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute_classes(texts)


def test_large_buckets_are_cut_into_blocks(make, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    base = prose(7, 200)
    texts = [edited(base, k, 0.01 + 0.002 * (k % 12)) for k in range(60)]
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(make(texts)).collect()}
    assert [found[i] for i in range(len(texts))] == brute_classes(texts)


def test_signatures_estimate_weighted_similarity():
    draw = np.random.default_rng(3)
    elements = draw.integers(0, 2**32, 300, dtype=np.uint32)
    first, second = draw.integers(1, 6, 300).astype(float), draw.integers(1, 6, 300).astype(float)
    rows = np.repeat([0, 1], 300)
    k = 2000
    both = neardup.signatures(rows, np.concatenate([elements, elements]), np.concatenate([first, second]), 2, k)
    wanted = np.minimum(first, second).sum() / np.maximum(first, second).sum()
    assert abs((both[0] == both[1]).mean() - wanted) < 0.05


def test_one_row_of_each_class_stays(make, odd, none):
    texts = planted()
    kept = neardup.keep_one(make(texts))
    assert kept.columns == make([]).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_classes(texts)))
    found = neardup.classes(odd).toPandas()
    assert len(found) == odd.count() and found[found.doc_id == 8].class_id.tolist() == [8, 8]
    assert neardup.keep_one(odd).filter("doc_id = 8").count() == 1
    assert neardup.classes(none).count() == 0 and neardup.keep_one(none).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [("hub", f"leaf{i}") for i in range(200)] + [("a", "a")]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {found[f"c{i:03d}"] for i in range(61)} == {"c000"} and {found[f"leaf{i}"] for i in range(200)} == {"hub"} and "a" not in found


def windows_again(texts, n):
    first = {}
    for i, text in enumerate(texts):
        words = (text or "").split()
        for j in range(len(words) - n + 1):
            first.setdefault(tuple(words[j : j + n]), i)
    return {(i, j) for i, text in enumerate(texts) for w in [(text or "").split()] for j in range(len(w) - n + 1) if first[tuple(w[j : j + n])] < i}


def test_passages_equal_brute_force(make):
    shared, other = prose(50, 52), prose(51, 200)
    texts = [
        prose(1, 100) + " " + shared + " " + prose(2, 30), shared, "é" * 40 + " " + shared + "\n" + prose(3, 10), prose(4, 20) + "\n" + other,
        other, prose(5, 7) + " " + " ".join(other.split()[20:110]) + " " + shared, prose(6, 300), " ".join(shared.split()[:49]) + " end", None, "", other + " " + other,
    ]
    found = passages.repeated(make(texts)).collect()
    covered = set()
    for r in found:
        text = texts[r["doc_id"]]
        assert text[r["start"] : r["end"]] == texts[r["first_doc_id"]][r["first_start"] : r["first_start"] + r["end"] - r["start"]]
        assert len(text[r["start"] : r["end"]].split()) == r["n_words"] >= 50
        begin = len(text[: r["start"]].split())
        covered |= {(r["doc_id"], j) for j in range(begin, begin + r["n_words"] - 49)}
    assert covered == windows_again(texts, 50)


def covered_again(found, texts):
    out = set()
    for r in found:
        text = texts[r["doc_id"]]
        assert text[r["start"] : r["end"]] == texts[r["first_doc_id"]][r["first_start"] : r["first_start"] + r["end"] - r["start"]]
        assert len(text[r["start"] : r["end"]].split()) == r["n_words"] >= 50 and r["first_doc_id"] < r["doc_id"]
        begin = len(text[: r["start"]].split())
        out |= {(r["doc_id"], j) for j in range(begin, begin + r["n_words"] - 49)}
    return out


def test_passages_whose_parts_lesser_documents_hold(make):
    shared = prose(60, 60).split()
    texts = [" ".join([prose(61, 30), *shared[:49], prose(62, 30)]), " ".join([prose(63, 30), *shared[-49:], prose(64, 30)])]
    texts += [" ".join([prose(65 + i, 40), *shared, prose(68 + i, 40)]) for i in range(2)]
    # a family of near copies, shuffled boilerplate, a second place in the first document, words of one sign
    base = prose(70, 600).split()
    for k in range(6):
        texts.append(" ".join(f"e{k}x{i}" if i % 38 == 6 * k else w for i, w in enumerate(base)))
    blocks, draw = [prose(80 + i, 30) for i in range(8)], random.Random(4)
    texts += [" ".join(draw.sample(blocks, 8)) for _ in range(12)]
    tail = prose(90, 40)
    texts += [f"{blocks[0]} {prose(91, 60)} {blocks[0]} {tail}", f"{prose(92, 9)} {blocks[0]} {tail}"]
    tiny = [draw.choice("abcdefgh") for _ in range(50)]
    texts += [" ".join([prose(93, 20), *tiny, "zz", prose(94, 20)]), " ".join([prose(95, 20), *tiny, "yy", prose(96, 20)])]
    texts += [" ".join(["p", "qr", "s"] * 40), "x " + " ".join(["qr", "s", "p"] * 17)]
    assert covered_again(passages.repeated(make(texts)).collect(), texts) == windows_again(texts, 50)


def test_an_insertion_moves_few_cuts():
    text = prose(9, 3000).encode()
    changed = text[:500] + b"inserted " + text[500:]
    before = {text[a:b] for b1 in passages.cuts([text]) for a, b in zip(b1[:-1], b1[1:], strict=True)}
    bounds = passages.cuts([changed])[0]
    after = {changed[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)}
    assert len(before - after) <= 4 and max(np.diff(bounds)) <= 2 * passages.WINDOW
    alone, together = passages.cuts([b"", text, b"x", changed]), passages.cuts([changed])
    assert alone[3].tolist() == together[0].tolist() and alone[0].tolist() == [0] and alone[2].tolist() == [0, 1]


def test_repeats_of_odd_rows(odd, none, make):
    assert passages.repeated(odd).count() == 0 or all(r["n_words"] >= 50 for r in passages.repeated(odd).collect())
    assert passages.repeated(none).count() == 0
    base = prose(3, 70)
    cut = passages.without_repeats(make([base, "start " + base + " end", None]))
    assert cut.columns == make([]).columns
    assert [r["text"] for r in cut.orderBy("doc_id").collect()] == [base, "start  end", None]


def test_fingerprints_follow_their_contract(make, odd, none):
    import hashlib

    texts = [prose(i, 20 + 30 * i) for i in range(9)] + ["", "short", prose(5, 170)]
    ids = [3 * i for i in range(len(texts))]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    found = {r["doc_id"]: r for r in syncmers.compare(make([texts[i] for i in order], ids=[ids[i] for i in order])).collect()}
    for i, text in enumerate(texts):
        tail = len(text) // 4
        changed = text[: len(text) - tail] + texts[(i + 1) % len(texts)][:tail]
        r = found[ids[i]]
        own, new, following = (syncmers.anchors([t])[0] for t in (text, changed, texts[(i + 1) % len(texts)]))
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == syncmers.fingerprint(own) and r["edited_fingerprint"] == syncmers.fingerprint(new)
        assert syncmers.read_fingerprint(r["fingerprint"]).tolist() == own.tolist()
        assert r["near_edited"] == syncmers.likeness(own, new) and r["near_next"] == syncmers.likeness(own, following)
    assert found[15]["fingerprint"] == found[33]["fingerprint"]
    assert syncmers.compare(odd).count() == odd.count() and syncmers.compare(none).count() == 0
    assert syncmers.compare(make(["alone in the table, this text"])).first()["near_next"] == 1.0


def test_short_texts_without_syncmers_have_an_anchor(make):
    import hashlib

    draw = random.Random(5)
    texts = ["".join(draw.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(size)) for size in range(16, 31) for _ in range(20)]
    found = syncmers.anchors(texts)
    assert all(len(x) for x in found) and len(syncmers.anchors([""])[0]) == 0
    assert [x.tolist() for x in found] == [syncmers.anchors([t])[0].tolist() for t in texts]
    assert all(syncmers.likeness(a, b) == 0.0 for a, b in zip(found, found[1:], strict=False))
    assert all(syncmers.likeness(x, syncmers.anchors([""])[0]) == 0.0 for x in found)
    rows = {r["doc_id"]: r for r in syncmers.compare(make(texts)).collect()}
    assert all(r["near_next"] == 0.0 and r["fingerprint"] for r in rows.values())
    whole = [i for i, t in enumerate(texts) if found[i].tolist() == [int.from_bytes(hashlib.sha256(t.encode()).digest()[:3], "big")]]
    assert len(whole) > 30 and all(rows[i]["near_edited"] == 0.0 for i in [*whole, *range(20)])


def test_anchors_match_in_the_order_of_their_places():
    parts = [prose(300 + i, 200) for i in range(6)]
    a, same, turned = syncmers.anchors([" ".join(parts), " ".join(parts), " ".join(parts[3:] + parts[:3])])
    assert syncmers.likeness(a, same) == 1.0 and 0.45 < syncmers.likeness(a, turned) < 0.55
    assert syncmers.likeness(np.array([5, 7, 5]), np.array([5, 5, 7])) == 2 / 3
    draw = np.random.default_rng(2)
    chance = [draw.integers(0, 2**24, 300_000, dtype=np.uint32) for _ in range(2)]
    assert syncmers.likeness(*chance) < 0.002


def test_syncmers_are_free_of_context():
    text = prose(4, 400)
    whole = set(syncmers.anchors([text])[0].tolist())
    part = syncmers.anchors([text[300:900]])[0].tolist()
    assert part and set(part) <= whole
    points = np.random.default_rng(0).integers(97, 101, 500)
    sample = "".join(map(chr, points))
    k, s = syncmers.K, syncmers.S
    picked = len(syncmers.anchors([sample])[0])
    assert 0.05 < picked / (500 - k + 1) < 2 * 2 / (k - s + 1) + 0.2
    assert isinstance(pa.array([1]), pa.Array)
