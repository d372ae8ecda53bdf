"""Surrogates: forms of address, scripts, hyphens, dense formats, and how many planted names are found."""

import random
import re

from quillspark.llm import pii

OWN = pii.Surrogates()


def new(text):
    return pii.rewrite(text, OWN)[0]


def test_forms_of_address_after_greetings_stay():
    out = new("Dear Mr Smith, thank you. Mr Jones and Mrs Lee agree, Smith too.")
    m = re.fullmatch(r"Dear Mr (\w+), thank you\. Mr (\w+) and Mrs (\w+) agree, (\w+) too\.", out)
    assert m and m[1] == m[4] and len({m[1], m[2], m[3], "Smith", "Jones", "Lee"}) == 6
    for text, pattern in (("Cher Monsieur Dupont, bonjour", r"Cher Monsieur \w+, bonjour"), ("Liebe Frau Anna Huber, wie", r"Liebe Frau \w+(?:a|ia|ina) \w+, wie"), ("Dear Sir, hello", "Dear Sir, hello"), ("Dear Mr Don, hello", r"Dear Mr (?!Don)\w+, hello")):
        assert re.fullmatch(pattern, new(text)), new(text)
    assert re.fullmatch(r"Dr\. (?!Smith)\w+ and Prof\. (?!Jones)\w+, Herr Dr\. (?!Kurz)\w+", new("Dr. Smith and Prof. Jones, Herr Dr. Kurz"))


def test_offices_are_no_names():
    for text in ("Dear Hiring Manager, the Manager of Hiring", "Mr President spoke to the President", "Madam Speaker, the Speaker", "Dear Customer Support, Support is"):
        assert new(text) == text


def test_scripts_hyphens_and_apostrophes_stay():
    out = new("Frau Müller-Lüdenscheidt kam, Lüdenscheidt ging. Mrs O'Brien said O'Brien.")
    m = re.fullmatch(r"Frau (\w+)-(\w+) kam, (\w+) ging\. Mrs O'(\w+) said O'(\w+)\.", out)
    assert m and m[2] == m[3] and m[4] == m[5] and "Müller" not in out and "Brien" not in out
    for word, block in (("محمد", r"[؀-ۿ]{4}"), ("王伟", r"[一-鿿]{2}"), ("たなか", r"[぀-ヿ]{3}"), ("김민", r"[가-힯]{2}"), ("דוד", r"[֐-׿]{3}"), ("Иван", r"[Ѐ-ӿ]+"), ("Νίκος", r"[Ͱ-Ͽ]+")):
        out = new(f"Mr {word} came, {word} left")
        m = re.fullmatch(rf"Mr ({block}) came, ({block}) left", out)
        assert m and m[1] == m[2] != word, out
    assert len({OWN.word(chr(0x4E00 + a) + chr(0x4E00 + b), "m") for a in range(60) for b in range(60)}) == 3600


def test_dense_formats_keep_all_apart(spark):
    for radices in ([10, 10], [7], [2, 3, 5], [256, 256], [26, 1, 10]):
        values = [[]]
        for r in radices:
            values = [[*v, d] for v in values for d in range(r)]
        image = [tuple(OWN.permute("x", v, radices)) for v in values]
        assert len(set(image)) == len(values) and all(list(i) != v for i, v in zip(image, values))
    rows = [("email", f"{a}{b}@{c}.de") for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz" for c in "abcdefghij"] + [("ip", f"192.168.{a}.{b}") for a in range(256) for b in range(0, 256, 5)] + [("ssn", f"{a:03d}-00-0000") for a in range(1000)]
    assert pii.key_for(spark.createDataFrame(rows, "kind string, entity string")) == 0
    assert new("password: ****** and token=......") == "password: ****** and token=......"  # nothing that could be replaced


def test_other_kinds_keep_their_form():
    assert re.fullmatch(r"0049 \d\d \d{6}", new("0049 30 123456")) and new("0049 30 123456") != "0049 30 123456"
    assert OWN.normal("phone", "0049 30 123456") == OWN.normal("phone", "+49 30 123456")
    token = "ghp_" + "aB3" * 12
    assert re.fullmatch(r"ghp_[A-Za-z0-9]{36}", new(token)) and new(token) != token
    full, short = new("2001:0db8:0000:0000:0000:0000:0001:0002").lower(), new("2001:db8::1:2")
    assert OWN.normal("ip6", full) == OWN.normal("ip6", short) and full.startswith("2001:") and OWN.normal("ip6", short) != OWN.normal("ip6", "2001:db8::1:2")
    for text in ("std::vector<int> a::b", "x[1::2]", "at 12:30:45", "00:1B:44:11:3A:B7"):
        assert new(text) == text


def test_recall_and_precision_on_planted_names():
    r = random.Random(11)
    names = ["Smith", "Müller-Lüdenscheidt", "O'Brien", "Dupont", "García", "Иванов", "王伟", "محمد", "van Dyk", "Nakamura", "Lefèvre", "Huber"]
    forms = ["Mr {}", "Mrs {}", "Dr. {}", "Prof. {}", "Herr {}", "Frau {}", "Monsieur {}", "Señora {}", "Dear Mr {}", "Lieber Herr {}", "Dear Anna {}", "Herr Dr. {}"]
    plain = ["the Sunday paper", "New York was cold", "Monday and Friday", "Hiring Manager wanted", "The President of the Board", "Mister", "Sir, please", "Dear all", "Version 1.2.3 of Python", "Miss the train"]
    found = missed = wrong = 0
    for _ in range(400):
        form, name, other = r.choice(forms), r.choice(names), r.choice(plain)
        text = f"{form.format(name)} wrote. {other}. Later {name} left."
        out = new(text)
        last = name.split()[-1]
        hit = last not in out
        found, missed = found + hit, missed + (not hit)
        wrong += other not in out
    assert missed / (found + missed) <= 0.1, (found, missed)  # what is missed: "van Dyk", which begins in lower case
    assert wrong / 400 <= 0.02, wrong
