import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from spreadframe.llm import mixing, packing, pii, rans, sharding, simhash, toxicity
from spreadframe.llm.bpe import Encoder
from spreadframe.llm.queries import ORACLES, QUERIES, tokenizer_file

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return cases.documents(spark).cache()


def ids_of(text, end):
    from tokenizers import Tokenizer

    global _TOKENIZER
    if "_TOKENIZER" not in globals():
        _TOKENIZER = Tokenizer.from_file(tokenizer_file())
        _TOKENIZER.encode_special_tokens = True
    return np.array(_TOKENIZER.encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


def test_words_remembered_give_the_ids_of_whole_texts():
    e = Encoder(tokenizer_file())
    for t in ["", "a  b", "a\n \n b", " x", "x ", "a \n", "tab\tb  c\n d", "it's 'quoted' 123", "日本 語  x", "\x1c \x1c"] + [t for _, t in cases.TEXTS if t]:
        assert e.encode([t])[0] == (e.whole(t) if t else b"")


# --- packing


def test_best_fit_decreasing_takes_the_tightest_window():
    place, offset, used = packing.best_fit_decreasing([5, 7, 3, 2, 8], 10)
    assert used == 3 and place[4] == 0 and place[3] == 0 and place[1] == 1 and place[2] == 1 and place[0] == 2
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 64, 500).tolist()
    place, offset, used = packing.best_fit_decreasing(lengths, 64)
    rooms, where = [], {}
    for i in sorted(range(500), key=lambda i: (-lengths[i], i)):
        fits = [(r, w) for w, r in enumerate(rooms) if r >= lengths[i]]
        if fits:
            room = min(r for r, _ in fits)
            assert 64 - offset[i] == room
            rooms[place[i]] -= lengths[i]
        else:
            assert place[i] == len(rooms) and offset[i] == 0
            rooms.append(64 - lengths[i])
    assert used == len(rooms)


def test_packing_holds_every_id_once(spark, odd):
    got = packing.pack_documents(odd, tokenizer_file(), window=128, bin_size=8, with_ids=True).collect()
    want = Counter((i, ids_of(t, 1).tobytes()) for i, t in cases.TEXTS)
    by = defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by[r["doc_id"]].append(r)
    for i, rows in by.items():
        mine = [k for k in want for _ in range(want[k]) if k[0] == i]
        assert sum(r["length"] for r in rows) == sum(len(x) // 4 for _, x in mine)
        if len(mine) == 1:
            assert b"".join(bytes(r["ids"]) for r in sorted(rows, key=lambda r: r["start"])) == mine[0][1]
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(filled) == list(range(len(filled)))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
    assert packing.pack_documents(cases.empty(spark), tokenizer_file()).count() == 0


# --- token files


def test_rans_blocks_round_trip_from_every_checkpoint():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 300_000) % 5000
    table = rans.Table(rans.frequencies(np.bincount(ids)))
    for n in (1, 5, rans.LANES, rans.LANES * rans.EVERY + 7, 300_000):
        block = rans.encode_block(ids[:n], table)
        assert (rans.decode_block(block, table) == ids[:n]).all()
        last = -(-n // (rans.LANES * rans.EVERY)) - 1
        assert (rans.decode_from(block, table, last) == ids[last * rans.LANES * rans.EVERY : n]).all()
    assert len(block) < 300_000 * 2
    broken = bytearray(block)
    broken[-9] ^= 1
    with pytest.raises(ValueError):
        rans.decode_block(bytes(broken), table)
    one = rans.Table(rans.frequencies(np.array([0, 9])))
    assert (rans.decode_block(rans.encode_block(np.ones(50, dtype=np.int64), one), one) == 1).all()


def test_token_files_in_order(spark, odd, tmp_path):
    rans.write_token_files(odd, str(tmp_path / "f"), tokenizer_file())
    got = sorted(rans.read_token_files(spark, str(tmp_path / "f")).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == Counter((i, ids_of(t, 2).tobytes()) for i, t in cases.TEXTS)
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(bytes(r["ids"]))
        at += r["n_tokens"]
    assert rans.token_files_roundtrip(cases.empty(spark), tokenizer_file()).count() == 0


# --- sharding


def test_communication_matrix_has_exact_margins():
    m = sharding.communication_matrix([10, 0, 23, 7], 3, 4)
    assert m.sum(1).tolist() == [10, 0, 23, 7] and sorted(m.sum(0).tolist()) == [13, 13, 14]


def test_hypergeometric_draws_follow_the_law_at_any_size(monkeypatch):
    """Inversion against the probabilities themselves, and a matrix beyond numpy's range."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(sharding, "NUMPY_MOST", 0)
    for good, bad, n in ((5, 9, 6), (3, 2, 5), (0, 4, 2), (7, 0, 3), (40, 60, 10)):
        drawn = Counter(sharding.hypergeometric(rng, good, bad, n) for _ in range(4000))
        for k in range(n + 1):
            p = math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n)
            assert abs(drawn[k] / 4000 - p) < 5 * math.sqrt(p * (1 - p) / 4000) + 1e-12
    monkeypatch.undo()
    m = sharding.communication_matrix([10**7] * 300, 16, 1)
    assert m.sum(1).tolist() == [10**7] * 300 and set(m.sum(0).tolist()) == {187_500_000}
    assert 0.9 < m.std() / math.sqrt(10**7 / 16 * 15 / 16) < 1.1


def test_sharding_merges_blocks_beyond_its_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 12)
    got = sharding.shard_rows(spark.range(0, 5000, 1, 16).withColumnRenamed("id", "doc_id"), shards=4).toPandas()
    assert sorted(got["doc_id"]) == list(range(5000)) and set(got.groupby("shard").size()) == {1250}
    assert all(sorted(g) == list(range(1250)) for _, g in got.groupby("shard")["slot"])


def test_shard_query_keeps_its_contract(spark, tiny):
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = QUERIES["op8_sharding"](spark, tiny).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(docs[r["doc_id"]]) + 1, zlib.crc32(docs[r["doc_id"]]), "rows", None) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_sharding_is_exact_and_whole(spark, odd):
    got = sharding.shard_rows(odd, shards=4).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(cases.TEXTS)
    assert {r["law"] for r in got} == {"rows"} and set(got[0].asDict()) == {*odd.columns, "slot"}
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_rows(cases.empty(spark)).count() == 0
    big = sharding.shard_rows(spark.range(20_000).withColumnRenamed("id", "doc_id")).toPandas()
    table = big.groupby([big["doc_id"] // 5000, "shard"]).size().unstack()
    assert ((table - 312.5) ** 2 / 312.5).to_numpy().sum() < 110  # chi square, 45 degrees of freedom
    assert abs(np.corrcoef(big["doc_id"], big["slot"])[0, 1]) < 0.03


def test_shards_are_written_in_slot_order(spark, odd, tmp_path):
    sharding.write_shards(sharding.shard_rows(odd, shards=3), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(cases.TEXTS)


# --- personal data


def luhn(digits):
    n = [int(x) for x in digits][::-1]
    return sum(n[::2] + [sum(divmod(2 * x, 10)) for x in n[1::2]]) % 10 == 0


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, least, most in ((2, r"[0-9]([\x20-]?[0-9])+", 14, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def test_pii_base_spans_equal_plain_patterns(spark, odd, tiny):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text"))
    rows = pii.find_pii(docs.withColumn("n_ip", docs["doc_id"])).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = base_spans(r["text"] or "")
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x[1] for x in want) for k in range(4)]
        listed = ",".join(f"{pii.BASE[k]}:{a}:{b}" for a, k, b in want)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s.split(":")[0] in pii.BASE] == [s for s in listed.split(",") if s] or not r["spans"]
    assert pii.find_pii(cases.empty(spark)).count() == 0


def test_pii_checksums_and_context():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert [s[0] for s in pii.spans("account GB82 WEST 1234 5698 7654 32 please")][-1] == "iban"
    with_word, without = pii.spans("card 4111111111111111"), pii.spans("it is 4111111111111111")
    assert with_word[0][3] > without[0][3]
    assert "ssn" in [s[0] for s in pii.spans("SSN 123-45-6789")] and "ssn" not in [s[0] for s in pii.spans("part 123-45-6789")]


def test_pii_of_long_runs_and_many_spans():
    text = "9" * 5000 + ".1.1.1 and " + "0" * 6000 + "1.2.3.4"
    assert [s[:3] for s in pii.spans(text)] == [("ip", 5011, len(text))]
    many = "GB82 WEST 1234 5698 7654 32 account a.b@c.org \n" * 3000
    assert len(pii.spans(many)) == 6000
    assert [s[0] for s in pii.spans("sk-" + "abcdefgh" * 4)] == ["key"]
    # an added span that touches a base span goes, one beside it stays
    assert pii._free([(0, 6, 5), (5, 6, 9), (20, 6, 30)], [(4, 0, 6), (10, 1, 20)]) == [(20, 6, 30)]
    text = 'token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e"; password: short1; secret=allletterswithoutdigits'
    assert [text[a:b] for k, a, b, _ in pii.spans(text) if k == "key"] == ["ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e"]
    assert "ab8c" not in pii._masked(text, pii.spans(text))


def test_redaction_masks_every_span(spark, odd):
    for r in odd.select("text", pii.redact(odd["text"]).alias("clean")).collect():
        assert (r["clean"] is None) == (r["text"] is None)
        assert not r["text"] or not base_spans(r["clean"])


# --- SimHash


def naive_print(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                root[find(b)] = find(a)
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(spark, odd, tiny):
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{tiny}/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text"))
    rows = simhash.simhash_groups(docs).collect()
    assert len(rows) == docs.count()
    prints = {r["text"]: naive_print(r["text"], 3) for r in rows}
    assert all(r["fingerprint"] == f"{prints[r['text']]:016x}" for r in rows)
    comp = components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    least = defaultdict(list)
    for r in rows:
        if r["doc_id"] is not None:
            least[comp[prints[r["text"]]]].append(r["doc_id"])
    assert all(r["component_id"] == min(least[comp[prints[r["text"]]]], default=None) for r in rows)
    assert sum(r["kept"] for r in rows) == len(set(comp.values()))
    assert all(r["doc_id"] == r["component_id"] for r in rows if r["kept"])
    assert simhash.simhash_groups(cases.empty(spark)).count() == 0


def test_deletion_variants_find_every_near_pair(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 30)]
    flips = lambda x, k: (((x & (1 << 64) - 1) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))) + (1 << 63)) % (1 << 64) - (1 << 63)
    prints = sorted({*base, *(flips(x, k) for x in base for k in (1, 2, 3, 4, 5) for _ in range(3))})
    got = {(r["a"], r["b"]) for r in simhash.near_pairs(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert got == {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & mask).bit_count() <= 3}


# --- mixing


def test_mixing_meets_targets(spark, odd, tiny):
    for docs in (odd, spark.read.parquet(f"{tiny}/documents.parquet")):
        rows = mixing.mix_sources(docs).collect()
        assert len(rows) == docs.count()
        assert all(r["size"] == len(WORD.findall(r["text"] or "")) for r in rows)
        size = defaultdict(int)
        for r in rows:
            size[r["source"]] += r["size"]
        order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        full, total = set(), 1.5 * sum(size.values())
        while True:
            free = [s for s in order if s not in full]
            level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in free) if free else 0
            over = {s for s in free if weight[s] * level >= 2 * size[s]}
            if not over:
                break
            full |= over
        target = {s: 2 * size[s] if s in full else weight[s] * level for s in order}
        for s in order:
            mine = [r for r in rows if r["source"] == s]
            assert all(math.isclose(r["target"], target[s], abs_tol=1e-6) and r["source_size"] == size[s] and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] for r in mine)
            assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(r["size"] for r in mine) / 2 + 1e-6
        again = mixing.mix_sources(docs, carry=["doc_id"]).collect()
        assert Counter((r["doc_id"], r["size"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again)
    assert mixing.mix_sources(cases.empty(spark)).count() == 0


def test_mixing_equals_its_sql(spark):
    import duckdb

    path, con = "/root/testdata/sf0.01", duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    key = lambda rows: sorted(tuple(r) for r in rows)
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    got, want = key(QUERIES["op3_mixing"](spark, path).select(*cols).collect()), key(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES['op3_mixing']})").fetchall())
    assert len(got) == len(want) and all(a[:3] == b[:3] and math.isclose(a[3], b[3]) and a[4] == b[4] for a, b in zip(got, want))


def test_longer_documents_are_likelier_in_proportion_of_their_odds(spark):
    """Two sizes in one source of ratio below one: shares of inclusion against the odds of 4 to 1."""
    rows = [(i, "w " * (40 if i % 2 else 10), "a") for i in range(4000)] + [(i, "w " * 3000, "b") for i in range(5000, 5030)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, weights=(1, 1)).where("source = 'a'").selectExpr("size", "copies - floor(target / source_size) as extra").groupBy("size").avg("extra").collect()
    p = {r["size"]: r[1] for r in got}
    odds = {k: v / (1 - v) for k, v in p.items()}
    assert 0.02 < p[10] < p[40] < 0.98 and 3 < odds[40] / odds[10] < 5.3


# --- toxicity


def test_toxicity_learns_words_and_stems(spark):
    rng = np.random.default_rng(3)
    plain = ["stone", "river", "cloud", "paper", "green", "walks", "often", "under", "light", "house"]
    rows, labels = [], []
    for i in range(1200):
        words = rng.choice(plain, 30).tolist()
        if i % 4 == 0:
            words[int(rng.integers(30))] = "grolt" + str(rng.choice(["ed", "ing", "s", "er", "ish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    odd = [(5000, None), (5001, ""), (None, "stone groltness river"), (5002, "stone groltful cloud " * 2000)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as held_out")
    known = spark.createDataFrame(labels + [(None, 1), (5000, 1), (7, None)], "doc_id long, toxic int")
    got = {(r["doc_id"], r["text"]): r for r in toxicity.score_toxicity(docs, known).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for (i, _), r in got.items())
    for (i, t), y in zip(rows, labels):
        assert got[(i, t)]["predicted"] == y[1]
    assert got[(None, "stone groltness river")]["predicted"] == 1 and got[odd[3]]["predicted"] == 1
    assert got[(5001, "")]["predicted"] == 0 == got[(5000, None)]["predicted"]
    # flipping a held-out label changes no score
    flip = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels], "doc_id long, toxic int")
    other = {(r["doc_id"], r["text"]): r["score"] for r in toxicity.score_toxicity(docs, flip).collect()}
    assert all(math.isclose(other[k], got[k]["score"], abs_tol=1e-9) for k in got)


def test_toxicity_without_labels_or_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_toxicity(odd, none).collect()} == {0.5}
    assert toxicity.score_toxicity(cases.empty(spark), none).count() == 0


def test_queries_run_on_the_smallest_tables(spark, tiny):
    for name in ("op2_licences", "op8_sharding"):
        assert QUERIES[name](spark, tiny).count() >= 0


def test_encoder_equals_whole_texts_across_generations(monkeypatch):
    """Words cut at changes of kind, remembered or forgotten, give the ids of whole texts."""
    from spreadframe.llm import bpe

    rng = random.Random(5)
    bits = ["a", "B", "é", "ɏ", "'s", "'", ".", ",", "\n", "\n\n", " ", "  ", "\t", "\r", "7", "42", "&&&", "İ", "中", " ", "ª", "²", "́", "😀", "<|endoftext|>", "_", "{", "~", "\x7f"]
    monkeypatch.setattr(bpe, "WORDS", 40)
    coder = Encoder(tokenizer_file())
    for _ in range(300):
        texts = ["".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(8)] + [None, ""]
        assert coder.encode(texts) == [coder.whole(t or "") for t in texts]
    assert coder.before
