import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.llm import secrets
from pixelloom.llm.queries import op5_secret_scan

TOKEN = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"


def brute_base(text):
    """Base spans by the letter of the contract: match, then drop."""
    letters = lambda w: "".join(f"[{c}{c.upper()}]" for c in w)
    words = "|".join([*map(letters, ("password", "passwd", "secret", "token")), letters("api") + "_?" + letters("key")])
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, b, secrets.KINDS[k]) for a, k, b in sorted(out)]


pieces = st.sampled_from(["password", "PassWD", "ſecret", "secret", "toKen", "toKen", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "\n", "abc", "x", "AKIA", "AKIAABCDEFGH2345", "0123456789ab", "deadbeefcafe", ".", "é", "日本", "-/+_"])


@settings(max_examples=500, deadline=None)
@given(st.lists(pieces, max_size=14).map("".join))
def test_base_spans(text):
    assert secrets.base_spans(text) == brute_base(text)


def test_a_failing_match_still_takes_its_place():
    assert secrets.base_spans("secret:token:abcdefgh") == brute_base("secret:token:abcdefgh") == []


def brute_entropy(run, window, least):
    covered = set()
    for i in range(len(run) - window + 1):
        n = Counter(run[i : i + window])
        if -sum(c / window * math.log2(c / window) for c in n.values()) >= least - 1e-9 / window:
            covered |= set(range(i, i + window))
    return covered


@settings(max_examples=300, deadline=None)
@given(st.text("0123456789abcdef", max_size=60), st.sampled_from([4, 8, 20]), st.sampled_from([1.0, 2.0, 2.75, 3.0]))
def test_incremental_entropy(run, window, least):
    got = secrets.entropy_windows(run, window, least)
    assert {x for a, b in got for x in range(a, b)} == brute_entropy(run, window, least)


def test_entropy_finds_keys_and_lets_public_strings_be():
    key = "Zx8Kq2Lm9Tv4Rb7Np1Wc6Yd3"
    (span,) = secrets.entropy_spans(f"see {key} here")
    assert span == (4, 4 + len(key), "entropy")
    for fine in ("123e4567-e89b-12d3-a456-426614174000", "inanouthtioningananti" * 2, "12345678901234567890123", "aaaa1111aaaa1111aaaa1111aaaa"):
        assert secrets.entropy_spans(f"see {fine} here") == []


def test_covered_entropy_is_not_repeated_and_masks_join():
    base, every = secrets.all_spans(f'x token = "{TOKEN}" y')
    assert [s[2] for s in base] == ["assign", "hex"] and every == base
    assert secrets.masked(f'x token = "{TOKEN}" y', every, "[S]") == 'x [S]" y'


def test_awkward_rows_and_redaction(spark, docs, awkward, tmp_path):
    rows = [*awkward, (20, f"é token = {TOKEN}\nrest"), (21, "AKIA" + "A1" * 10), (22, f"{TOKEN} " * 3000)]
    docs(rows, extra=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in op5_secret_scan(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = brute_base(t or "")
        line = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert got[i]["base_sha256"] == secrets.digest(line) and set(filter(None, line.split(","))) <= set(got[i]["spans"].split(","))
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == x for _, _, k in base) for x in secrets.KINDS[:3])
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs(rows, extra=True)).collect()}
    assert clean[1] is None and clean[2] == "" and clean[9] == dict(rows)[9] and TOKEN not in clean[20] + clean[22]
    assert clean[20].endswith("\nrest") and secrets.redact(docs([])).count() == 0


def test_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert op5_secret_scan(spark, str(tmp_path)).count() == 0


def brute_entropy_of_text(text):
    """Every window of every stretch by its own count, then joined where they meet."""
    found = set()
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if any(a.fullmatch(m[0]) for a in secrets.ALLOWED):
            continue
        for chars, window, least in (("[0-9a-fA-F]+", 20, 3.0), ("[A-Za-z0-9+/_=-]+", 20, 3.9)):
            for part in re.finditer(chars, m[0]):
                if len(part[0]) < window or any(a.fullmatch(part[0]) for a in secrets.ALLOWED):
                    continue
                for i in range(len(part[0]) - window + 1):
                    counts = Counter(part[0][i : i + window]).values()
                    if -sum(c / window * math.log2(c / window) for c in counts) >= least - 1e-9:
                        found |= set(range(m.start() + part.start() + i, m.start() + part.start() + i + window))
    return found


def test_entropy_of_every_class_by_brute_force():
    rng = random.Random(7)
    kinds = ["0123456789abcdef", "ABCDEFabcdef0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "ab01", "0123456789", "abcdefgh-"]
    for _ in range(300):
        text = " ".join("".join(rng.choice(rng.choice(kinds)) if rng.random() < 0.05 else rng.choice(k) for _ in range(rng.randrange(15, 60))) for k in rng.choices(kinds, k=4))
        got = {i for a, b, _ in secrets.entropy_spans(text) for i in range(a, b)}
        assert got == brute_entropy_of_text(text), text


def test_covered_spans_are_not_repeated():
    rng = random.Random(8)
    for _ in range(200):
        text = " ".join(rng.choice(["token=", "secret: ", "", "api_key='"]) + "".join(rng.choice("0123456789abcdefXYZ+/") for _ in range(rng.randrange(10, 50))) for _ in range(6))
        base, every = secrets.all_spans(text)
        extra = [s for s in secrets.entropy_spans(text) if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)]
        assert sorted(every) == sorted(base + extra)
