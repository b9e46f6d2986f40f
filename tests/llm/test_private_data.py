import hashlib
import random
import re

from pyspark.sql import functions as F

from replyforest.llm import private_data as pd

NAMES = ("email", "ip", "card", "phone")


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(part) <= 255 for part in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


PARTS = ["a", "b9", "@", ".", "+", "-", " ", "1", "23", "255", "4111 1111 1111 1111", "(", ")", "_", "é", "😀", "\n", "%", "x@y.z", "10.0.0.1", "+1 555 123 4567", 'token = "', "24be64439e3e49cf46b2d7c90f3602a3", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "0"]


def test_base_spans_are_those_of_the_plain_patterns(documents, clash):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", "1" * 60_000, "1." * 30_000, "a." * 30_000 + "@", "a@b" + ".c" * 30_000, "+1" + " 1" * 20_000, "x@y.z 10.0.0.1 " * 3000]
    for r in pd.find_private_data(clash(documents(texts))).collect():
        spans = base_spans(texts[r.doc_id] or "")
        listed = ",".join(f"{NAMES[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert not spans or set(listed.split(",")) <= set(r.spans.split(","))


def spans(documents, text):
    return pd.find_private_data(documents([text])).first().spans


def test_checksums_and_context_decide_the_other_kinds(documents):
    assert spans(documents, "pay to GB82 WEST 1234 5698 7654 32 now") == "iban:7:34"
    assert spans(documents, "pay to GB82 WEST 1234 5698 7654 33 now") == ""
    assert spans(documents, "IBAN DE89370400440532013000") == "iban:5:27"
    secret = "24be64439e3e49cf46b2d7c90f3602a3"
    assert spans(documents, f"token = {secret}") == "secret:8:40" and spans(documents, f"commit {secret}") == ""
    assert spans(documents, "my SSN is 123-45-6789") == "ssn:10:21" and spans(documents, "part 123-45-6789") == ""


def test_account_numbers_beside_words_in_capitals(documents):
    cases = {
        "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX": ["DE89 3704 0044 0532 0130 00"],
        "é😀 DE89370400440532013000 2024": ["DE89370400440532013000"],
        "GB29 NWBK 6016 1331 9268 19 I will pay": ["GB29 NWBK 6016 1331 9268 19"],
        "GB29 NWBK 6016 1331 9268 19 A B C D E F G": ["GB29 NWBK 6016 1331 9268 19"],
        "NO9386011117947 NO9386011117947": ["NO9386011117947"] * 2,
        "DE89 3704 0044 0532 0130 00 GB29 NWBK 6016 1331 9268 19 X": ["DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"],
        "AB12 DE89 3704 0044 0532 0130 00": ["DE89 3704 0044 0532 0130 00"],
        "DE89 3704 0044 0532 0130 01 BIC": [],
        "DE89370400440532013000BIC": [],
    }
    rows = pd.with_spans(documents(list(cases))).collect()
    for r in rows:
        text = list(cases)[r.doc_id]
        found = [s for s in r.spans if s.kind == pd.KINDS.index("iban")]
        assert [s.value for s in found] == cases[text] and all(text[s.start : s.end] == s.value for s in found), text
    clean = pd.without_private_data(documents(["IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX"])).first().text
    assert clean == "IBAN [IBAN] BIC COBADEFFXXX"


def test_the_countrys_length_decides_between_two_right_checksums(documents):
    own = "DE89 3704 0044 0532 0130 00"
    longer = next(w for w in (f"{own} {i}" for i in range(1000, 10_000)) if _leaves_one(w))
    assert spans(documents, longer) == f"iban:0:{len(own)}"


def _leaves_one(number):
    plain = number.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def test_redaction(documents, clash):
    rows = clash(documents(["mail x@y.z, 10.0.0.1", "é😀 +1 555 123 4567!", "clean 12", None, "1.2.3.4111 1111 1111 1111"]))
    clean = pd.without_private_data(rows)
    assert clean.columns == rows.columns and clean.schema["n_chars"].dataType == rows.schema["n_chars"].dataType
    found = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert found[0] == ("mail [EMAIL], [IP]", 18) and found[1] == ("é😀 [PHONE]!", 11)
    assert found[2] == ("clean 12", None) and found[3] == (None, None)
    assert all(not base_spans(text) for text, _ in found.values() if text and "[" in text)


def test_nothing_but_built_in_functions(documents):
    text = pd.find_private_data(documents(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", text.split("Scan")[0])


def test_many_spans_keep_their_places(spark):
    row = spark.range(1).select(F.lit(0).alias("doc_id"), F.expr("repeat('ab x@y.z ', 2000)").alias("text"))
    places = [int(s.split(":")[1]) for s in pd.find_private_data(row).first().spans.split(",")]
    assert places == [3 + 9 * i for i in range(2000)]


def test_empty_table(documents):
    assert pd.find_private_data(documents([])).count() == 0 and pd.without_private_data(documents([])).count() == 0
