import hashlib
import re

import pytest
import regex
from pyspark.sql import functions as F

from livgrid.llm import pii, queries
from livgrid.llm.storage import Work

KEY = "a test key"


def luhn(digits):
    d = [int(x) for x in digits]
    return (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0


def run(spark, texts, key=KEY):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, entities string")
    return [(r["text"], [(e["kind"], t[e["start"] : e["end"]], e["surrogate"]) for e in r["entities"]]) for r, t in zip(sorted(pii.replace(df, Work(spark, "t"), key).collect(), key=lambda r: r["doc_id"]), texts, strict=True)]


TEXTS = [
    "Mail anna.b7@mail5.example.com, or ANNA.B7@mail5.example.com. Call +1 (456) 555-2186 or 456-555-2186!",
    "Card 4337166598464399 and 4337 1665 9846 4399, not 4337166598464398. é😀 IP 39.197.112.39, 10.1.2.3 and 192.168.7.9; version 2.0, 1.2.3.4.5",
    "SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00 or DE89370400440532013000.",
    "Mr. John Smith met Mrs. Mary Smith and Dr. SMITH. г-жа Иванова и г-н Иванов. κ. Παπαδόπουλος",
    "Nothing here: Licensed under the Apache License, Version 2.0. In 2024 we had 1,000 items.",
    "",
    "other.person@mail5.example.com other.person@elsewhere.org",
]


def test_surrogates_keep_type_and_coreference(spark):
    out = run(spark, TEXTS)
    (mail, mail2, phone, phone2) = out[0][1]
    assert [m[0] for m in out[0][1]] == ["email", "email", "phone", "phone"]
    assert mail[2] == mail2[2] != mail[1] and re.fullmatch(r"[a-z]{4}\.[a-z]\d@[a-z]{10}\.example", mail[2])
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", phone[2]) and re.sub(r"\D", "", phone[2])[1:] == re.sub(r"\D", "", phone2[2])
    card, card2, public, private, home = out[1][1]
    assert card[0] == "card" and luhn(card[2]) and card[2][0] == "4" and len(card[2]) == 16 and card2[2].replace(" ", "") == card[2] and card2[2].count(" ") == 3
    assert all(re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", x[2]) and all(int(o) < 256 for o in x[2].split(".")) for x in (public, private, home))
    assert private[2].startswith("10.") and home[2].startswith("192.168.") and not re.match(r"10\.|192\.168\.|127\.|172\.", public[2])
    assert "4337166598464398" in out[1][0] and "1.2.3.4.5" in out[1][0]
    ssn, iban, iban2 = out[2][1]
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", ssn[2]) and iban[2].replace(" ", "") == iban2[2] and len(iban[2]) == len(iban[1])
    moved = iban2[2][4:] + iban2[2][:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 and iban2[2].startswith("DE")
    john, mary, smith, woman, man, greek = (n[2].split(" ") for n in out[3][1])
    assert john[0] == "Mr." and john[-1] == mary[-1] and smith[-1] == smith[-1].upper() and john[1] != "John" and mary[1].endswith(pii.GIVEN["latin"]["f"])
    assert john[1].endswith(pii.GIVEN["latin"]["m"]) and woman[-1].endswith(pii.SURNAME["cyrillic"]["f"]) and man[-1].endswith(pii.SURNAME["cyrillic"]["m"]) and greek[-1].endswith(pii.SURNAME["greek"]["m"])
    assert [out[i] for i in (4, 5)] == [(TEXTS[4], []), ("", [])]
    a, b = (x[2].split("@") for x in out[6][1])
    assert a[1] == mail[2].split("@")[1] != b[1]
    for (text, found), old in zip(out, TEXTS, strict=True):
        rebuilt = old
        for _, was, new in found:
            rebuilt = rebuilt.replace(was, new, 1)
        assert text == rebuilt
    assert run(spark, TEXTS) == out and run(spark, TEXTS, "another")[0] != out[0]


def test_collisions_are_resolved(spark, monkeypatch):
    # so few surrogates that they collide, and some are entities themselves
    monkeypatch.setattr(pii, "_ip", lambda canon, h, key: F.concat(F.lit("9.9.9."), (F.pmod(pii._number(h, 0), F.lit(40)) + 10).cast("string")))
    texts = [f"ip 8.8.{i}.1 and 9.9.9.{i + 10} twice 8.8.{i}.1" for i in range(10)]
    out = run(spark, texts)
    seen = {}
    for _, found in out:
        assert found[0][2] == found[2][2]
        for _, was, new in found:
            assert seen.setdefault(was, new) == new
    assert len(set(seen.values())) == len(seen) == 20 and not set(seen) & set(seen.values())
    monkeypatch.setattr(pii, "BROADCAST_ROWS", -1)
    assert run(spark, texts) == out


def test_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a@b.org"), (1, None), (2, "a@b.org"), (2, "a@b.org")], "doc_id long, text string")
    rows = pii.replace(df, Work(spark, "t"), KEY).collect()
    assert len(rows) == 4 and len({r["text"] for r in rows if r["text"]}) == 1 and sum(r["text"] is None for r in rows) == 1
    assert pii.replace(df.limit(0), Work(spark, "t"), KEY).count() == 0


@pytest.mark.parametrize("table", ["documents"])
def test_query(spark, sf, table):
    rows = queries.op2_pii_surrogates(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/{table}.parquet").collect()}
    assert len(rows) == len(texts)
    emails = {e for t in texts.values() for e in re.findall(r"[\w.]+@[\w.]+\w", t)}
    after = " ".join(r["text"] for r in rows)
    assert emails and not any(e in after for e in emails)
    assert all(r["text"] == texts[r["doc_id"]] for r in rows if not r["n_entities"])


def plain_matches(text):
    """(start, end, kind) of the patterns' matches by another engine, one kind after the other at each place."""
    every = regex.compile("|".join(f"(?:{p})" for p in pii.KINDS.values()).replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))
    out = []
    for m in every.finditer(text):
        for kind, p in pii.KINDS.items():
            if regex.fullmatch(p, m[0]) and (kind != "card" or luhn(re.sub(r"\D", "", m[0]))):
                out.append((m.start(), m.end(), kind))
                break
    return out


def plain_spans(text):
    """The same with the other places of names' words."""
    found = plain_matches(text)
    titles = set(re.split(r"\|", pii._TITLES)) | {"M"}
    words, hidden = set(), text
    for a, b, kind in found:
        hidden = hidden[:a] + " " * (b - a) + hidden[b:]
        if kind in ("name", "person"):
            parts = text[a:b].split(" ")
            words |= {w.lower() for w in (parts[1:] if parts[0].rstrip(".") in titles else parts)}
    found += [(m.start(), m.end(), "name") for m in regex.finditer(pii.MENTION, hidden) if m[0].lower() in words] if words else []
    return sorted((a, b, "name" if kind == "person" else kind) for a, b, kind in found)


NAMES = [
    "Dr Alice Brown came. Brown spoke, and Alice left; BROWN'S coat and Brownie stayed.",
    "John Miller wrote. Miller is a miller, says Mr Alex Kim.",
    "Dr Alex Kim and Ms. O'Brien-Smith; Kim, O'Brien-Smith's dog. 😀 é Kim",
    "Jean Dupont, Marie Curie et Mme Curie. Curie!",
    "Иван Петров и г-н Петров. Петров ушёл.",
    "In May John said May. Mary Ann Lee Harvey Oswald",
    "Mark my words, Rose garden and Grace period stay; Mr and Mrs too.",
]


@pytest.mark.parametrize("whole", [False, True])
def test_equals_a_plain_version(spark, sf, whole):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] if whole else [*TEXTS, *NAMES]
    mapped: dict = {}
    for (text, found), old in zip(run(spark, texts), texts, strict=True):
        want = plain_spans(old)
        assert [(was, kind) for kind, was, _ in found] == [(old[a:b], kind) for a, b, kind in want], old
        left, at = "", 0
        for (a, b, kind), (_, was, new) in zip(want, found, strict=True):
            left, at = left + old[at:a] + new, b
            shape = lambda x: re.sub("[A-Za-z]", "a", re.sub(r"\d", "0", x))
            if kind in ("phone", "card", "ssn", "iban"):
                assert shape(new) == shape(was)
            canon = {"email": str.lower, "phone": lambda x: re.sub(r"\D", "", x)[-10:], "ip": str}.get(kind, lambda x: re.sub(r"[^0-9A-Za-z]", "", x))
            for was, new in zip(was.split(" "), new.split(" "), strict=True) if kind == "name" else [(canon(was), canon(new))]:
                key = (kind, was.lower() if kind == "name" else was)
                assert mapped.setdefault(key, new.lower() if kind == "name" else new).lower() == new.lower()
        assert text == left + old[at:]
    for kind in {k for k, _ in mapped}:
        outs = [v for (k, _), v in mapped.items() if k == kind]
        assert len(set(outs)) == len(outs)


def test_names_are_one_identity_over_titles_and_places(spark):
    out = run(spark, NAMES)
    alice, brown = out[0][1][0][2].split(" ")[1:]
    assert [x[2] for x in out[0][1][1:]] == [brown, alice, brown.upper()] and "'S coat and Brownie" in out[0][0] and "Alice" not in out[0][0]
    assert out[1][1][0][2].split(" ")[1] == out[1][1][1][2] and "a miller, says" in out[1][0]
    alex, kim = out[1][1][2][2].split(" ")[1:]
    assert out[2][1][0][2].split(" ") == ["Dr", alex, kim] and out[2][1][-1][2] == kim and alex.endswith(pii.GIVEN["latin"]["m"])
    assert out[3][1][1][2].split(" ")[1] == out[3][1][2][2].split(" ")[1] == out[3][1][3][2]
    petrov = out[4][1][0][2].split(" ")[1]
    assert out[4][1][1][2].split(" ")[1] == out[4][1][2][2] == petrov and petrov.endswith(pii.SURNAME["cyrillic"]["m"])
    assert out[6][1] == []


def test_names_of_all_kinds_are_distinct(spark):
    syllable = lambda i: "".join("bcdfghjklm"[int(d)] + "a" for d in f"{i:03d}").capitalize()
    texts = [f"Mr {syllable(i)} and Mrs {syllable(i + 400)} and Dr {syllable(i)} Z{syllable(i).lower()}" for i in range(400)]
    mapped = {}
    for _, found in run(spark, texts):
        for _, was, new in found:
            for a, b in zip(was.split(" ")[1:], new.split(" ")[1:], strict=True):
                assert mapped.setdefault(a, b) == b
    assert len(mapped) == 1200 and len(set(mapped.values())) == 1200


def test_private_addresses_do_not_run_out(spark):
    texts = [" ".join(f"192.168.{i // 200}.{i % 200 + k}" for k in range(0, 50)) for i in range(0, 40_000, 50)]
    own = {x for t in texts for x in t.split()}
    texts += ["10.0.0.1 10.255.255.255 172.16.0.0 172.31.9.9 127.0.0.1 192.168.255.255"]
    mapped = {was: new for _, found in run(spark, texts) for _, was, new in found}
    assert len(own) == 40_000 and own <= set(mapped) and len(set(mapped.values())) == len(mapped) and all(a != b for a, b in mapped.items())
    assert all(b.startswith("192.168.") for a, b in mapped.items() if a in own)
    assert mapped["10.0.0.1"].startswith("10.") and mapped["127.0.0.1"].startswith("127.") and re.match(r"172\.(1[6-9]|2\d|3[01])\.", mapped["172.16.0.0"])
    assert all(all(0 <= int(o) < 256 for o in b.split(".")) for b in mapped.values())


def test_long_texts(spark):
    texts = ["x@" + "a." * 3000, "y@" + "b" * 70 + ".org", "z" * 1_000_000 + "@mail.org end", "a@" + "b." * 126 + "org", "1" * 50_000, "A" * 50_000, "@" * 20_000, "Mr " * 5000]
    out = run(spark, texts)
    assert [len(f) for _, f in out[:4]] == [0, 0, 1, 1] and len(out[2][0]) > 1_000_000 and "zzz" not in out[2][0]


def test_time_grows_with_the_matches(spark):
    import time

    def seconds(n):
        text = " é ".join(f"u{hashlib.md5(str(i).encode()).hexdigest()[:8]}@mail.org Mr Bond{'abcdefghij'[i % 10]}x" for i in range(n))
        began = time.perf_counter()
        [(_, found)] = run(spark, [text])
        assert len(found) == 2 * n
        return time.perf_counter() - began

    seconds(100)
    small, large = seconds(3_000), seconds(12_000)
    assert large < 8 * small + 5


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a@b.org", 5, 6, "k", 7)], "doc_id long, text string, __row long, __hits long, kind string, __made long")
    [r] = pii.replace(df, Work(spark, "t"), KEY).collect()
    assert (r["__row"], r["__hits"], r["kind"], r["__made"]) == (5, 6, "k", 7) and r["text"] == r["entities"][0]["surrogate"] != "a@b.org"
