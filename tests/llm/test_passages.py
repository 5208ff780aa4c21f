from collections import defaultdict

from keyfold.llm import line_dedup
from tests.llm.test_tables import docs


def passage(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_long_passages_go_at_every_source_size(spark):
    rows = []
    for i in range(400):  # one source in which no passage is on a tenth of the documents
        lines = [f"own line {i}", passage("own", 60) + str(i)]
        lines += [passage("p", 51)] if i % 40 == 0 else []  # 10 texts
        lines += ["  " + passage("q", 60) + "\t"] if i in (5, 6, 7) else []
        lines += [passage("two", 60)] if i in (15, 16) else []  # fewer than three texts
        lines += [passage("short", 50)] if i % 40 == 1 else []  # not over 50 words
        rows.append((i, "\n".join(lines), "hot"))
    rows += [(500 + k, passage("across", 70) + f"\nend {k}", f"s{k}") for k in range(3)]  # a source each
    rows += [(600 + k, passage("copy", 80) + "\nfooter", f"s{k}") for k in range(4)]  # whole copies are left to the next stage
    table = docs(spark, rows)
    out = {r.doc_id: r.text for r in line_dedup.dedup_documents(table).collect()}
    assert len(out) == len(rows)
    holders = defaultdict(list)
    for i, text, _ in rows:
        for name in ("p", "q", "two", "short", "across", "copy"):
            assert f"{name}0 " in text or f"{name}0 " not in out[i]
            if f"{name}0 " in out[i]:
                holders[name].append(i)
    assert {k: len(v) for k, v in holders.items()} == {"p": 1, "q": 1, "two": 2, "short": 10, "across": 1, "copy": 4}
    for i, text, _ in rows:  # nothing else goes
        lost = set(text.split("\n")) - set(out[i].split("\n"))
        assert all(x.split()[0] in ("p0", "q0", "across0") for x in lost)
