"""Redaction against a corpus of nested JSON, headers, exception text and URL queries: no secret survives, and JSON stays JSON."""

from __future__ import annotations

import json
import random
import time

from pyspark.sql import functions as F

from lodestone.functions import text as tx

TEXTS = {
    '{"api_key": "abc"': '{"api_key": [secret]', "Authorization: Bearer abc.def": "Authorization: [secret]", "GET /x\r\nset-cookie: sid=1; Path=/\r\nHost: h.com": "GET /x\r\nset-cookie: [secret]\r\nHost: h.com",
    "https://user:pw@h.com/p": "https://[secret]@h.com/p", "https://h.com/cb?access_token=abc&state=1#id_token=x.y&z=2": "https://h.com/cb?access_token=[secret]&state=1#id_token=[secret]&z=2",
    "Traceback: login(password='p w', n=1)": "Traceback: login(password=[secret], n=1)", 'ValueError: {"client_secret":{"a":"x"},"n":1}': 'ValueError: {"client_secret":[secret],"n":1}',
    "mail a.b@c.example now": "mail [email] now", r"open C:\Users\ann\x.txt failed": r"open C:\Users\[user]\x.txt failed", "/home/ann/x": "/home/[user]/x", "proxy http://u:p@10.0.0.1:3128 refused": "proxy http://[secret]@10.0.0.1:3128 refused",
    "storage_state=[1,2] kept": "storage_state=[secret] kept", "nothing here": "nothing here", "": "", "sent bearer abcdef123 twice": "sent bearer [secret] twice", r'body "{\"refresh_token\": \"r1\", \"n\": 2}"': r'body "{\"refresh_token\": [secret], \"n\": 2}"',
}
JSON = {
    '{"token":["a","b"]}': {"token": "[secret]"}, '{"password":{"a":"x"},"b":1}': {"password": "[secret]", "b": 1}, '{"Set-Cookie":["sid=1"],"access_token":5,"n":null}': {"Set-Cookie": "[secret]", "access_token": "[secret]", "n": None},
    ' [ {"a" : [ {"X-Api-Key" : {"k":[{"z":"}"}]}}, "]" ] }, 2 ] ': [{"a": [{"X-Api-Key": "[secret]"}, "]"]}, 2], r'{"q\"":"{\"secret\":\"s\",\"m\":[1]}","pass\u0077ord":"x"}': {'q"': '{"secret":"[secret]","m":[1]}', "password": "[secret]"},
    r'{"url":"https:\/\/h.com\/?token=t1&b=2","e":"failed: Cookie: a=b\nnext"}': {"url": "https://h.com/?token=[secret]&b=2", "e": "failed: Cookie: [secret]\nnext"}, '{"a":{},"b":[],"c":"\\u00e9\\\\"}': {"a": {}, "b": [], "c": "é\\"},
    '{"secret":{}}': {"secret": "[secret]"}, '{"secret":[]}': {"secret": "[secret]"}, '"token=abc"': None, "[1,2.5e3,true,null]": [1, 2500.0, True, None], '{"token":"a","token2":{"token":"b"}}': {"token": "[secret]", "token2": "[secret]"},
}


def redacted(spark, texts, f):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r[0]: r[1] for r in df.select("t", f(F.col("t"))).collect()}


def test_texts(spark):
    assert redacted(spark, TEXTS, tx.redacted) == TEXTS
    assert redacted(spark, [None], tx.redacted) == {None: None}


def test_json(spark):
    got = redacted(spark, JSON, tx.redacted_json)
    assert {t: None if want is None else json.loads(got[t]) for t, want in JSON.items()} == JSON
    assert got['"token=abc"'] == '"token=[secret]'  # a lone string is text


def test_no_secret_survives_in_random_documents(spark):
    rng, leaks = random.Random(3), 0

    def value(depth, hidden):
        kind = rng.randrange(6 if depth < 4 else 3)
        if kind == 0:
            return f"LEAK{rng.randrange(10**6)}" if hidden else f"plain {rng.randrange(99)}"
        if kind == 1:
            return 7_000_000 + rng.randrange(10**5) if hidden else rng.randrange(99)
        if kind == 2:
            return json.dumps(value(depth + 2, hidden)) if depth < 3 else "[{\"}"
        if kind == 3:
            return [value(depth + 1, hidden) for _ in range(rng.randrange(4))]
        return {name: value(depth + 1, hidden or any(x in name.lower() for x in ("token", "passw", "cookie", "auth"))) for name in rng.sample(["a", "Token", "user_password", "b \"q", "Cookie", "n", "proxy-authorization", "c\\"], rng.randrange(1, 4))}

    docs = [json.dumps({"x": value(0, False), "y": value(0, False)}, indent=rng.choice([None, 1])) for _ in range(300)]
    got = redacted(spark, docs, tx.redacted_json)
    for doc in docs:
        json.loads(got[doc])
        assert "LEAK" not in got[doc] and "700" not in got[doc], (doc, got[doc])
        leaks += "LEAK" in doc
    assert leaks > 40


def test_guards_change_nothing_and_spare_long_runs(spark):
    """Texts in which any pattern may match, or another one's replacement stands, are as the plain patterns in turn leave them."""
    pieces = ["http://u:p@h/x", "Authorization: Basic abc", "SET-COOKIE = a; b", "bearer abcdef.g", "my_API-key: 'a b'", "session-id=", "tokens", "token \\t= x", "a.b@c.de_x@y.zz", "C:\\\\Users\\\\me", "/HOME/me/x", "://", "@", "K:=", "passw=1", "secret=[a]", "\n", "plain words"]
    rng = random.Random(5)
    texts = [" ".join(rng.sample(pieces, k)) for k in (1, 1, 2, 3, 5) for _ in range(60)] + ["", *pieces]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.col("t")
    for pattern, kept in tx.REDACTIONS:
        plain = F.regexp_replace(plain, pattern, tx.replacement(kept, "$"))
    t = F.col("t")
    wrong = df.filter(~tx.redacted(t).eqNullSafe(plain) | ~tx.has_email(t).eqNullSafe(t.rlike(tx.EMAIL)) | ~tx.has_secret(t).eqNullSafe(t.rlike(tx.SECRET)))
    assert [r[0] for r in wrong.collect()] == []
    # one run of 60,000 characters was searched anew from each of them
    long = spark.createDataFrame([("aB3_" * 15_000,)], "t string")
    began = time.time()
    assert long.filter(tx.redacted(t).eqNullSafe(t) & ~tx.has_email(t) & ~tx.has_secret(t)).count() == 1
    assert time.time() - began < 5
