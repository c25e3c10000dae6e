"""Media, token counts, pieces, licenses, personal data, toxicity and repeats: brute force on the odd documents."""

import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from shelfprice.llm import licenses, media, pieces, pii, repeats, token_counts, toxicity
from shelfprice.llm.common import shared_dir

from .conftest import odd_texts, prose

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


def counted(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def test_media(odd, nothing):
    def row(doc, text):
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        return doc, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])

    features = media.media_features(media.to_media(odd)).cache()
    assert counted(features.select("id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()) == Counter(row(i, t) for i, t, _ in odd_texts())
    files = {(r["id"], r["n_bytes"]): r for r in media.to_media(odd).collect()}
    for r in features.collect():
        stored = bytes(files[r["id"], r["n_bytes"]]["media"])
        assert hashlib.sha256(stored).hexdigest() == r["media_sha256"] and len(stored) == r["media_bytes"]
        assert bytes(r["tile"])[:6] == b"\x93NUMPY" and len(r["dhash"]) == 16
    assert media.media_features(media.to_media(nothing)).count() == 0


@pytest.mark.parametrize("kind", media.KINDS)
def test_image_files(kind):
    payload = random.Random(3).randbytes(576 * 3)
    image = media.decode(media.encode(payload, kind))
    assert image.tobytes() == payload
    grey = image.mean(axis=2)
    whole = media.area_resize(image, grey.shape[0], grey.shape[1])
    assert np.allclose(whole, grey)
    fine = np.kron(grey, np.ones((8, 9)))  # each cell of the grid is then a whole number of parts
    h, w = grey.shape
    expected = fine.reshape(8, h, 9, w).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(image, 8, 9), expected)


def test_netpbm_comments_and_bmp_from_above():
    assert media.decode(b"P5 # made by hand\n2 # wide\n 1\n255\n\x01\x02").tolist() == [[[1], [2]]]
    upright = bytearray(media.encode(bytes(range(144)), "bmp"))
    upright[22:26] = (-2).to_bytes(4, "little", signed=True)
    assert media.decode(bytes(upright))[0, 0].tolist() == media.decode(media.encode(bytes(range(144)), "bmp"))[1, 0].tolist()


@pytest.mark.parametrize("data", [b"P5", b"P5\n", b"P5 1", b"P6 2 2 ", b"P5 # no end", b"P5 x 1 255 a", b"P5 3 3 255\nab", b"BM", b"BM" + b"\0" * 30, b"", b"GIF89a"])
def test_files_that_are_cut_off(data):
    with pytest.raises(ValueError):
        media.decode(data)


def test_token_counts(spark, odd, nothing, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    cache = f"file://{tmp_path}/cache"
    expected = Counter((i, len((t or "").encode()), count(t)) for i, t, _ in odd_texts())
    for _ in range(2):  # the second time all comes from the cache
        assert counted(token_counts.count_tokens(odd, cache, WORD).collect()) == expected
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.select("digest").distinct().count() == len({" ".join(re.split("[ \t\n\r]+", t or "")).strip() for _, t, _ in odd_texts()})
    more = spark.createDataFrame([(1, "quite new words"), (2, "one two"), (2, "one two")], "doc_id long, text string")
    before = spark.read.parquet(cache).count()
    assert counted(token_counts.count_tokens(more, cache, WORD).collect()) == Counter((i, len(t), count(t)) for i, t in [(1, "quite new words"), (2, "one two"), (2, "one two")])
    assert spark.read.parquet(cache).count() == before + 1
    special = ["a<|endoftext|>b", "<|startoftext|>", "<|STARTOFTEXT|> x", "é ́x İ ſ", "don't  we'LL  x'"]
    frame = spark.createDataFrame(list(enumerate(special)), "doc_id long, text string")
    assert counted(token_counts.count_tokens(frame, cache, WORD).select("id", "n_tokens").collect()) == Counter((i, count(t)) for i, t in enumerate(special))
    assert token_counts.count_tokens(nothing, cache, WORD).count() == 0


def test_pieces(odd, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    decoded = pieces.decode_pieces(pieces.encode_pieces(odd, PIECE), PIECE).collect()
    assert Counter((r["id"], tuple(r["ids"])) for r in decoded) == Counter((i, tuple(library.encode(t or ""))) for i, t, _ in odd_texts())
    assert Counter((r["id"], r["text"]) for r in decoded) == Counter((i, t or "") for i, t, _ in odd_texts())
    once = pieces.round_trip(odd, PIECE).select("id", "ids_sha256", "text_sha256", "n_tokens", "n_bytes").collect()
    assert counted(once) == Counter((r["id"], r["ids_sha256"], r["text_sha256"], r["n_tokens"], r["n_bytes"]) for r in decoded)
    assert pieces.round_trip(nothing, PIECE).count() == pieces.decode_pieces(pieces.encode_pieces(nothing, PIECE), PIECE).count() == 0


def test_texts_without_blanks_are_cut_where_no_piece_reaches():
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.Pieces.load(PIECE)
    rng = random.Random(7)
    texts = ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(20_000)), "".join(rng.choices("abcdeABC012+/=", k=3000)), "".join(rng.choices("日本語テキスト東京大学のはを", k=5000)), "é" * 500 + "x" * 500, " " * 300 + "y", "https://a.b/" + "q=1&" * 200]
    began = time.process_time()
    got = [np.frombuffer(x, np.int32).tolist() for x in model.encode(texts)]
    assert time.process_time() - began < 15
    assert got == [library.encode(t) for t in texts]
    assert all("".join(model.cut(t)) == t for t in texts)


def test_models_that_change_texts_are_refused(tmp_path):
    assert pieces.model_specs(PIECE)[0] == 2
    (tmp_path / "m.model").write_bytes(b"\x12\x02\x18\x02\x1a\x02\x20\x01")  # BPE that removes extra blanks
    assert pieces.model_specs(str(tmp_path / "m.model")) == (2, {4: 1})
    with pytest.raises(ValueError):
        pieces.Pieces.load(str(tmp_path / "m.model"))


def test_unigram_viterbi_is_the_best_path():
    rng = random.Random(5)
    vocabulary = sorted({"▁"} | {"".join(rng.choices("ab▁"[:2], k=n)) for n in (1, 2, 3, 4) for _ in range(6)} | {"▁a", "▁ab"})
    scores = [-rng.random() * 5 - 0.1 for _ in vocabulary]
    model = pieces.Pieces(["<unk>", *vocabulary], [0.0, *scores], [False] + [True] * len(vocabulary), merges=False)
    worth = dict(zip(vocabulary, scores, strict=True))

    def best(word: str) -> float:
        table = [0.0] + [-np.inf] * len(word)
        for e in range(1, len(word) + 1):
            table[e] = max(table[s] + worth.get(word[s:e], -np.inf) for s in range(e))
        return table[-1]

    for _ in range(50):
        word = "▁" + "".join(rng.choices("ab", k=8))
        if best(word) == -np.inf:
            continue
        ids = np.frombuffer(model.viterbi([word])[0], np.int32)
        assert "".join(model.pieces[i] for i in ids) == word
        assert sum(model.scores[i] for i in ids) == pytest.approx(best(word))


def test_licenses(spark, odd, nothing):
    extra = [
        (50, "Released under the MIT License.\nmit  license, MIT-License", "a"), (51, "GNU general Public\nlicense", "a"), (52, "words before. Permission is hereby granted, free of charge, to any person who has a copy of this software", "a"),
        (53, "apache License mit License", "a"), (54, "Licensed under CC BY-NC 4.0.", "a"), (55, " ".join(["filler"] * 100) + " licensed under the mozilla public license version 2 0 " + " ".join(["filler"] * 100), "a"),
    ]
    rows = [(i, t) for i, t, _ in [*odd_texts(), *extra]]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(low))

    def row(doc, text):
        w = split(text)
        at = [(i, label) for i in range(len(w)) for p, label in licenses.PHRASES if w[i : i + len(p.split())] == p.split()]
        base, own = {label for _, label in at}, set()
        lines = re.split("\n", (text or "").translate(low))
        for line in lines:
            v = split(line)
            blocks = [v] if len(v) <= 64 else [v[a : a + 64] for a in range(0, len(v), 32)]
            for t, label, *must in licenses.TEMPLATES:
                if any(len(set(b) & set(t.split())) >= 0.8 * len(set(t.split())) - 1e-9 and set(*must) <= set(b) for b in blocks):
                    own.add(label)
        places = [i for i, _ in at]
        return doc, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | own))

    assert Counter((r["id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in got) == Counter(row(*x) for x in rows)
    notices = ["licensed under the GNU General Public License, version 3", "Licensed under CC BY-NC 4.0", "released under the apache license", "licensed under the gnu lesser general public license version 3"]
    labels = [r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(notices)), "doc_id long, text string")).orderBy("id").collect()]
    assert "lgpl" not in labels[0] and "cc-by-sa" not in labels[1] and "mit" not in labels[2] and "lgpl-notice" in labels[3]
    assert {"mit-notice", "mit-grant", "cc-by-nc", "mpl-notice"} <= {label for r in got for label in r["labels"].split(",")}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert licenses.scan_licenses(odd).count() == len(odd_texts()) and licenses.scan_licenses(nothing).count() == 0


def test_licenses_wrapped_over_lines(spark):
    grants = {
        "bsd-grant": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted",
        "gpl-grant": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License",
        "mit-grant": "Permission is hereby granted,\r\nfree of charge,\n\nto any person obtaining a copy\n of this software",
    }
    rows = [(f"{label}/{n}", f"{prose(n, n)}\n{text}\n{prose(150 - n, n + 1)}", label) for label, text in grants.items() for n in range(1, 140, 3)]
    rows += [(label, text, label) for label, text in grants.items()]
    got = {r["id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string, label string")).collect()}
    assert all(label in got[i]["labels"].split(",") and got[i]["score"] == 1 for i, _, label in rows)
    far = "\n".join(f"{w} {prose(40, k)}" for k, w in enumerate("redistribution and use in source and binary forms with or without modification".split()))
    assert licenses.scan_licenses(spark.createDataFrame([(1, far)], "doc_id long, text string")).first()["labels"] == ""
    long = " ".join(f"word{i}" for i in range(90))
    wrapped = f"{prose(70, 1)}\n{long[:300]}\n{long[301:]}\n{prose(70, 2)}"
    assert licenses.scan_licenses(spark.createDataFrame([(1, wrapped)], "doc_id long, text string"), templates=[(long, "long")]).first()["labels"] == "long"


PII_TEXTS = [
    "mail a.b+c@x-y.co.uk, again A@b.c. or x@y", "ip 10.0.0.1 and 300.1.1.1 or 1.2.3.4.5", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 378282246310005", "+1 (415) 555-2671 or +12 3",
    "call +49 30 901820 1.2.3.4", "a@b.c@d.e 5555555555554444@x.y", "@ + . 1", *[f"token AKIAIOSFODNN7EXAMP{a}{b} here" for a in "QRST" for b in "2345"], "same 4111111111111111 then 4111111111111111.", "", "é@ü.com mail é x@y.zz",
]


def naive_spans(text: str):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_pii(spark, odd, nothing):
    rng = random.Random(8)
    fuzz = ["".join(rng.choices("01.2 -+()@a", k=rng.randint(0, 80))) for _ in range(400)] + ["".join(rng.choices("a@.b@", k=rng.randint(0, 40))) for _ in range(200)]
    assert [pii.base_spans(t) for t in fuzz + PII_TEXTS] == [naive_spans(t) for t in fuzz + PII_TEXTS]
    rows = [(i, t) for i, t, _ in odd_texts()] + list(enumerate(PII_TEXTS * 3, 100))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit_pii(frame)
    got = pii.find_pii(frame, model).collect()
    assert Counter((r["id"], r["base_sha256"], r["n_card"]) for r in got) == Counter((i, hashlib.sha256(pii.spelled(naive_spans(t or "")).encode()).hexdigest(), sum(s[2] == 2 for s in naive_spans(t or ""))) for i, t in rows)
    for r in got:
        assert set(filter(None, r["base"].split(","))) <= set(filter(None, r["spans"].split(",")))
    assert any("secret" in r["spans"] for r in got)
    assert all(r["n_spans"] == len(list(filter(None, r["spans"].split(",")))) and r["n_secret"] == r["spans"].count("secret:") for r in got)
    masked = pii.mask_pii(frame.withColumn("n", frame["doc_id"]), model)
    assert masked.columns == ["doc_id", "text", "n"] and not masked.where("text like '%4111111111111111%'").count()
    assert pii.find_pii(odd, model).count() == len(odd_texts()) and pii.find_pii(nothing, model).count() == 0
    assert pii.fit_pii(nothing).unary.shape == model.unary.shape


def test_messages_are_exact_on_a_chain_and_doubles_agree():
    rng = np.random.default_rng(2)
    model = pii.SkipChain(rng.normal(size=(pii.N_FEATURES, pii.SkipChain.labels)), rng.normal(size=(pii.SkipChain.labels,) * 2), np.zeros(pii.SkipChain.labels))
    graph = pii.Graph(["11 22 33"])
    assert len(graph.chain) == 2 and not len(graph.skip)
    own, k = graph.x @ model.unary, model.labels
    joint = np.exp(own[0][:, None, None] + own[1][None, :, None] + own[2] + model.transition[:, :, None] + model.transition[None])
    exact = [joint.sum(axis=(1, 2)), joint.sum(axis=(0, 2)), joint.sum(axis=(0, 1))]
    assert np.allclose(model.marginals(graph, settled=1e-10), [e / e.sum() for e in exact], atol=1e-6) and k == 6
    model.agree = np.full(k, 3.0)
    doubles = pii.Graph(["12345678 " + "word " * 50 + "12345678"])
    assert len(doubles.skip) == 1 and len(pii.Graph(["a1b2c3 x " * 9]).skip) == 1 + 2 * 7
    model.unary[0, 2] += 0.5
    assert len(set(model.marginals(doubles).argmax(axis=1).tolist())) == 1


def by_enumeration(model: pii.SkipChain, graph: pii.Graph) -> np.ndarray:
    """The marginals of all labellings, weighed one by one."""
    own, n, k = graph.x @ model.unary, len(graph.where), model.labels
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        score = sum(own[i, y] for i, y in enumerate(labels)) + sum(model.transition[labels[a], labels[b]] for a, b in graph.chain)
        score += sum(model.agree[labels[a]] for a, b in graph.skip if labels[a] == labels[b])
        out[range(n), labels] += np.exp(score)
    return out / out.sum(axis=1, keepdims=True)


def test_messages_over_skip_edges_against_enumeration():
    rng = np.random.default_rng(3)
    size = (pii.N_FEATURES, pii.SkipChain.labels)
    for text, loops in (("1234567 and 12 34 and 1234567, 56", False), ("77 12345678 88 or 12345678 99", True), ("1234567 a 1234567 b 1234567 c 12", True)):
        graph = pii.Graph([text])
        assert len(graph.skip)
        for strength in (0.3, 1.0):
            model = pii.SkipChain(rng.normal(size=size) * 0.3, rng.normal(size=(pii.SkipChain.labels,) * 2) * strength, np.abs(rng.normal(size=pii.SkipChain.labels)) * strength)
            got, exact = model.marginals(graph), by_enumeration(model, graph)
            # Without a loop messages are exact; with one they are close, and the likeliest label is the same.
            assert np.allclose(got, exact, atol=0.08 if loops else 1e-4)
            sure = np.sort(exact, axis=1)[:, -1] - np.sort(exact, axis=1)[:, -2] > 0.2
            assert (got.argmax(axis=1) == exact.argmax(axis=1))[sure].all()


def test_documents_do_not_change_each_others_marginals():
    rng = np.random.default_rng(4)
    model = pii.SkipChain(rng.normal(size=(pii.N_FEATURES, pii.SkipChain.labels)), rng.normal(size=(pii.SkipChain.labels,) * 2), np.full(pii.SkipChain.labels, 2.0))
    texts = ["12 34 56 78 1234567 and 1234567", "1 2", "x " + "55 66 1234567 " * 40]
    together, at = model.marginals(pii.Graph(texts)), 0
    for t in texts:
        alone = model.marginals(pii.Graph([t]))
        assert np.allclose(together[at : at + len(alone)], alone, atol=1e-9)
        at += len(alone)
    # Forty mentions of one number are two links apart at most, so they agree.
    assert len(set(together[-120:].argmax(axis=1)[2::3].tolist())) == 1


@pytest.mark.parametrize("text", ["1" * 10**6, "a" * 10**6 + "@b", "1." * 10**5, "1.1.1." + "0" * 10**6 + "1", "1 " * 10**4, "a@" * 10**5, "@" * 10**6, "+1" + "-" * 10**6, "a" * 10**6 + "@b.c", "1-" * 10**5, "1.2.3.4 " * 10**4])
def test_long_runs_take_no_longer_than_their_length(text):
    began = time.process_time()
    pii.find_spans([text], pii.SkipChain())
    pii.candidates(text)
    assert time.process_time() - began < 10


def test_long_numbers(spark):
    rows = [(1, "9" * 5000 + ".1.1.1 and 1.1.1." + "0" * 5000 + "7"), (2, "1" * 10**6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: r for r in pii.find_pii(frame, pii.fit_pii(frame)).collect()}
    assert got[1]["n_ip"] == 1 and got[2]["n_ip"] == got[2]["n_card"] == 0


def test_toxicity_grammar():
    run = lambda s: toxicity._GRAMMAR.run(s)
    assert run("yi|")[0] == ["y", "iY", "|"] and run("ni|")[0] == ["n", "iN", "|"] and run("rwwi|i|")[0] == ["r", "w", "w", "iR", "|", "i", "|"]
    assert run("yfwt|")[0][-2] == "tFY"
    assert run("yi|")[1] > run("i|")[1] > run("ri|")[1] > run("rni|")[1]


def plain_features(text: str, model: toxicity.ToxicityModel) -> list[float]:
    """The features word by word: symbols from the lexicon, clauses cut at their ends, the four marks set one after the other."""
    symbol = {w: s for s, ws in toxicity.LEXICON.items() for w in ws} | dict.fromkeys(model.words, "i")
    clauses, words = [[]], 0
    for piece in re.findall(r"[a-z\x80-\U0010ffff]+|[.!?;:\n]", text.lower()):
        if piece in ".!?;:\n":
            clauses.append([])
            continue
        words += 1
        kind = symbol.get(piece) or ("i" if any(len(piece.encode()) > len(x.encode()) and piece.startswith(x) for x in model.stems) else "w")
        clauses[-1].append(kind)
    count, best, heavy, hit = Counter(), 0.0, 0.0, 0
    for clause in clauses:
        if not set(clause) & {"i", "t"}:
            continue
        hit += 1
        weight, reach = 0.0, dict.fromkeys("RNFY", 0)
        for kind in clause:
            if kind in "it":
                on = {m for m in reach if reach[m]}
                weight += (-0.6 if "R" in on else 0) + (-0.8 if "N" in on else 1) + (0.5 if "F" in on else 0) + (0.7 if "Y" in on else 0)
                name = "reported" if "R" in on else "negated" if "N" in on else "planned" if kind == "t" and "F" in on else "threats" if kind == "t" else "targeted" if "Y" in on else "asserted"
                count[name] += 1
            for mark, opens, far in (("R", "r", 12), ("N", "n", 3), ("F", "f", 4), ("Y", "y", 5)):
                reach[mark] = far if kind == opens else max(0, reach[mark] - 1)
        best, heavy = max(best, weight), heavy + max(0.0, weight)
    if not hit:
        return [0.0] * len(toxicity.FEATURES)
    return [*(np.log1p(count[k]) for k in toxicity.FEATURES[:6]), best, np.log1p(hit), np.log1p(heavy), min(1.0, 12 * heavy / words)]


def test_toxicity_features_by_brute_force():
    rng = random.Random(12)
    model = toxicity.ToxicityModel(["zorblax"], ["grumm", "été"])
    words = [w for ws in toxicity.LEXICON.values() for w in ws[:4]] + "zorblax zorblaxing grumm grummel étés été house, tree. river! Ünd x1y don't IDIOT".split()
    texts = [" ".join(rng.choices(words + ["filler"] * 30, k=rng.randint(0, 60))) for _ in range(300)] + ["", "idiot", ". . .", "you\nidiot", "x" * 5000 + " you idiot " + "y " * 5000]
    got = model.features(texts)
    assert np.allclose(got, [plain_features(t, model) for t in texts], atol=1e-9)


def test_toxicity(spark, odd, nothing):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(240):
        words = prose(30, 500 + i).split()
        toxic = i % 4 == 0
        if toxic:
            words[10], words[20] = rng.choice(["idiot", "zorblax", "zorblaxing"]), "you idiot."
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (999, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, marks)
    assert any("zorblax".startswith(s) for s in model.stems) or "zorblax" in model.words
    scored = {r["id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 30 and all((scored[i] >= 0.3) == (i % 4 == 0) for i in held)
    shown = {r["doc_id"]: r["h"] for r in docs.select("doc_id", toxicity.is_held_out(docs["doc_id"]).alias("h")).collect()}
    assert all(shown[i] == (i in held) for i, _ in rows)
    got = toxicity.score_toxicity(odd, model).collect()
    assert len(got) == len(odd_texts()) and all(0 <= r["score"] < 0.3 for r in got)
    assert toxicity.score_toxicity(nothing, model).count() == 0
    assert toxicity.drop_toxic(docs, model).count() == 180
    assert toxicity.fit_toxicity(docs, marks.limit(0)) == toxicity.ToxicityModel()


def test_cuts_follow_content():
    text = prose(400, 6).encode()
    cuts = repeats.cut_points([text, b"", b"x", "é".encode() * 2000, text])
    assert cuts[0] == cuts[4] and cuts[1] == [] and cuts[2] == [1]
    for t, c in zip([text, "é".encode() * 2000], [cuts[0], cuts[3]], strict=True):
        sizes = np.diff([0, *c])
        assert c[-1] == len(t) and sizes.max() <= 384 and sizes[:-1].min() >= 8
        assert all((t[x] & 0xC0) != 0x80 for x in c[:-1])
    moved = repeats.cut_points([text[:700] + b"something put in here " + text[700:]])[0]
    assert len({x - 22 for x in moved if x > 900} - set(cuts[0])) <= 2
    h, data = 0, text[:100]
    for b in data:
        h = ((h << 1) + int(repeats._GEAR[b])) % (1 << 32)
    assert repeats.gear_hashes([b"zz", data])[1][2 + 32 + 99] == h


def test_repeats(spark, odd, nothing):
    passages = [prose(60, 900 + k) for k in range(20)]
    rows = [(i, f"{prose(80 + i, 2000 + i)} {passages[i % 20]} {prose(50, 3000 + i)}") for i in range(40)] + [(100 + i, prose(150, 4000 + i)) for i in range(20)] + [(None, rows_text) for rows_text in ["", None]]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spans = repeats.repeated_spans(frame).cache()
    got = {(r["id"], r["first_id"]) for r in spans.collect()}
    assert {i for i, _ in got} <= set(range(40)) and len({i for i, _ in got}) >= 38
    assert all(i % 20 == f for i, f in got)
    text = dict(rows)
    for r in spans.collect():
        part = text[r["id"]].encode()[r["start"] : r["end"]].decode()
        assert part.strip() in text[r["first_id"]] and r["is_first"] == (r["id"] == r["first_id"])
    left = {r["id"]: r["text"] for r in repeats.cut_repeats(frame, spans).collect() if r["id"] is not None}
    assert all(left[i] == text[i] for i in left if i < 20 or i >= 100)
    assert all(len(left[i]) < len(text[i]) for i in range(20, 40) if i in {x for x, _ in got})
    odd_spans = repeats.repeated_spans(odd).collect()
    assert {r["id"] for r in odd_spans} == {1, 2, 3, None}
    assert repeats.repeated_spans(nothing).count() == 0
    assert repeats.cut_repeats(odd, repeats.repeated_spans(odd)).count() == len(odd_texts())


def covered(rows, least: int) -> dict:
    """By brute force: the bytes of each text that windows of another id's texts cover."""
    owners: dict[bytes, set] = {}
    for i, t in rows:
        data = (t or "").encode()
        for a in range(len(data) - least + 1):
            owners.setdefault(data[a : a + least], set()).add(i)
    out = {}
    for i, t in rows:
        data = (t or "").encode()
        hit = [any(o != i for o in owners[data[a : a + least]]) for a in range(len(data) - least + 1)]
        out[i, t] = {x for a, h in enumerate(hit) if h for x in range(a, a + least)}
    return out


def test_repeats_are_all_found(spark):
    rng = random.Random(11)
    word = lambda k: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäé", k=k))
    passages = [" ".join(word(rng.choice([2, 3, 4])) for _ in range(51)) for _ in range(40)]
    passages += ["ab " * 40 + word(8), "x" * 130, "0123456789" * 12]
    rows = [(k, f"{word(90 + 3 * k)} {p} {word(70)}") for k, p in enumerate(passages)]
    rows += [(100 + k, f"{word(60 + 7 * k)} {p} {word(90)}") for k, p in enumerate(passages)]
    # A near beginning in a lesser id, a copy of another's copy, an exact least length, one byte less.
    rows += [(-1, passages[0][:100] + word(50)), (300, rows[5][1]), (301, word(30) + rows[6][1][100:212] + word(30)), (302, word(30) + "q" + rows[7][1][60:150]), (None, passages[1]), (None, passages[2] + word(40))]
    spans = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    texts = {repeats._tag(t.encode()): t for _, t in rows}
    got: dict = {r: set() for r in rows}
    for r in spans:
        text = texts[r["tag"]].encode()
        assert r["n_bytes"] == r["end"] - r["start"] >= 112 and text[r["start"] : r["end"]].decode() and r["repeat_bytes"] <= r["n_bytes"]
        got[r["id"], texts[r["tag"]]] |= set(range(r["start"], r["end"]))
    expected = covered(rows, 112)
    for (i, t), bytes_ in expected.items():
        # A character that the end of a window cuts may be left out.
        plain = {x for x in bytes_ if t.encode()[x] < 0x80}
        assert got[i, t] <= bytes_ and plain <= got[i, t], i
    assert sum(k in {r["id"] for r in spans} for k in range(100, 140)) == 40
    # The way of crowded anchors finds the same rows.
    crowded = repeats.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), crowd=0).collect()
    assert sorted(map(repr, crowded)) == sorted(map(repr, spans))


def test_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
