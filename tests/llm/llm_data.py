"""Small odd tables, and plain-Python versions of what the operators promise."""

from __future__ import annotations

import base64
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Names that the operators use themselves; a table may have them too.
CLASHING = ["row", "row_key", "bucket", "kind", "ref", "score", "lang_pred", "rejected", "fingerprint", "root", "low", "text_", "d0", "mark", "owner"]

ODD_TEXTS = [
    None, "", " ", "   ", "\t\n", "a", "A", "a b c", "A  b\tc", "a b c d e", "the The THE the", "x" * 3000,
    "word " * 800, "é È ñ ß", "日本語 テキスト", "\U0001f600 smile", "tail ", " head", "a\nb", "a\r\n\r\nb", "1 2 3", "!!! ???",
]


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text))


def documents(spark, rows, clash=True):
    """documents of (doc_id, text, lang) rows, with further columns of clashing names."""
    names = CLASHING if clash else []
    data = [(i, t, lang, "src", None if t is None else len(t), *[f"{c}{n}" for c in names]) for n, (i, t, lang) in enumerate(rows)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", `{c}` string" for c in names)
    return spark.createDataFrame(data, schema).repartition(3)


def odd_rows():
    """Odd texts, each twice, with NULL and repeated identifiers."""
    rows = [(i, t, "en" if i % 2 else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(i + 100, t, "de") for i, t in enumerate(ODD_TEXTS)]
    return rows + [(None, "a b c", "en"), (None, None, None), (7, "a b c", "en"), (7, "a b c", "en"), (None, "alone and without a number", None)]


def sentence(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def groups(links, nodes):
    """node -> smallest reachable node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def foreign():
    """Texts of 200 characters and more in no language of the corpus."""
    rng = random.Random(5)
    finnish = "Suomen kieli on uralilainen kieli jota puhutaan Suomessa ja jonka puhujia on myös Ruotsissa ja Norjassa sekä monissa muissa maissa ympäri maailmaa, ja se on yksi unionin virallisista kielistä vuodesta yhdeksänkymmentäviisi lähtien. "
    polish = "Język polski należy do grupy zachodniosłowiańskiej i jest używany głównie w Polsce, gdzie mówi nim niemal cała ludność kraju, a także w wielu krajach świata, między innymi w Niemczech, Wielkiej Brytanii oraz Stanach Zjednoczonych. "
    words = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(60))
    greek = "Η ελληνική γλώσσα ανήκει στην ινδοευρωπαϊκή οικογένεια γλωσσών " * 4
    return [finnish, finnish * 20, polish, polish * 20, words, words * 20, greek, base64.b64encode(rng.randbytes(300)).decode(), rng.randbytes(3000).hex()]
