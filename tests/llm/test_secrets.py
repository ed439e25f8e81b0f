import hashlib
import random
import re
import zlib

from fixtures import SCHEMA, extra, ordered, rows, table

from loomtrace.llm import queries, secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def checked(prefix):
    body = "0123456789abcdefghijABCDEFGHIJ"
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, d = divmod(value, 62)
        digits = secrets.BASE62[d] + digits
    return prefix + body + digits.rjust(6, "0")


def made():
    draw = random.Random(3)
    parts = ["password", "Token", "secretoken", "api_key", "APIKEY", "'", '"', " ", ":", "=", "= ", "abc123", "AKIA", "AKIAKIA", "ABCDEFGHIJ0123456789", "deadbeef", "0123456789abcdef", "g", "é", "\n", "passwd=secret=abcdef", "x"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 60))) for _ in range(300)]
    return [(n, t, "en", "a", len(t)) for n, t in enumerate(texts)] + rows()


def test_base_spans(spark, tmp_path):
    table(spark, made()).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for m in made():
        spans = brute(m[1])
        want.append((m[0], *(sum(s[0] == k for s in spans) for k in secrets.BASE), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    assert ordered(queries.op8_secrets(spark, str(tmp_path)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)
    assert sum(w[1] for w in want) > 20 and sum(w[2] for w in want) > 20 and sum(w[3] for w in want) > 20


def test_checksums():
    good, npm = checked("ghp_"), checked("npm_")
    assert [s[0] for s in secrets.find(f"x {good} y {npm}")] == ["github", "npm"]
    assert secrets.find(f"x {good[:-1]}{'A' if good[-1] != 'A' else 'B'} y") == []
    assert [s[0] for s in secrets.find("Visa 4111 1111 1111 1111.")] == ["card"] and secrets.find("Visa 4111 1111 1111 1112.") == []
    key = "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"
    assert [s[0] for s in secrets.find(key)] == ["wallet"] and secrets.find(key[:-1] + "j") == []


def test_extra_columns_and_empty_table(spark):
    assert secrets.scan(extra(spark, rows()[:9])).count() == 9
    assert secrets.scan(spark.createDataFrame([], SCHEMA)).count() == 0
