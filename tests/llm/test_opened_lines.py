"""Whole texts are parsed in the first round only; later ones see the lines of common leaves."""

from __future__ import annotations

import pyarrow as pa

from saleroom.llm import lines

NAMES = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu") for b in ("ron", "lia", "met", "sko", "pan")]
LEAST = 5


def texts_of(n):
    """A template with a name, a line as it is, and lines of their own, with odd ends, white space and characters."""
    texts = []
    for k, name in enumerate(NAMES[:n]):
        own = [f"own{k}é{j} stands{j} here{k} ☃{k + j} alone{k}" for j in range(10)]
        template, same = f"This is a message from {name} the moderator", "Read on\tbelow, dear ünknown reader\r"
        texts.append("\n".join([*own[:4], template, " \x0b\f ", "", *own[4:], same]) + ("\n" if k % 2 else ""))
    return texts


def table(texts, ids=None):
    return pa.table({"doc_id": pa.array(ids or range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "part": pa.array([0] * len(texts), pa.int64())})


def asked(sent):
    """Keys of a round with their documents, without the places they are known by."""
    return sorted((r["keys"], r["ids"], r["runs"]) for r in sent.to_pylist())


def test_only_looked_into_lines_go_on():
    rows = table([*texts_of(20), None, "", "nothing shared in here"])
    replies = lines._common(0, LEAST)(lines._send(0, 1, LEAST)(rows))
    opened = lines._open(rows, replies).sort_by("row")
    assert opened.column("row").to_pylist() == list(range(20))
    for k, text in enumerate(opened.column("text").to_pylist()):
        assert text == f"This is a message from {NAMES[k]} the moderator\nRead on\tbelow, dear ünknown reader\r" + ("\n" if k % 2 else "")
    assert sum(map(len, opened.column("text").to_pylist())) < 0.3 * sum(map(len, texts_of(20)))
    assert asked(lines._send(1, 1, LEAST)(opened)) == asked(lines._send(1, 1, LEAST)(rows, replies)) != []


def test_no_line_is_looked_into():
    rows = table(["one line of its own", None, ""])
    replies = lines._common(0, LEAST)(lines._send(0, 1, LEAST)(rows))
    opened = lines._open(rows, replies)
    assert opened.num_rows == 0 and lines._send(1, 1, LEAST)(opened).num_rows == 0
    assert lines._gone(opened, replies).num_rows == 0


def test_cut_by_spans(frame):
    texts = texts_of(20)
    rows = [(None, texts[0]), *((k, t) for k, t in enumerate(texts[1:], 1)), (3, texts[3]), (40, None), (41, ""), (42, " \n\f\n")]
    found = lines.without_templates(frame("doc_id BIGINT, text STRING", *rows), least=LEAST).collect()
    assert len(found) == len(rows)
    for r in found:
        k = r["doc_id"]
        if k in (40, 41, 42):
            assert (r["text"], r["n_lines"], r["n_dropped"]) == ({40: None, 41: "", 42: " \n\f\n"}[k], 0, 0)
        elif k is None:
            assert (r["text"], r["n_lines"], r["n_dropped"]) == (texts[0], 12, 0)
        else:
            left = [line for line in texts[k].split("\n")[:-1 if k % 2 else None] if not line.startswith(("This is", "Read on"))]
            assert (r["text"], r["n_lines"], r["n_dropped"]) == ("\n".join(left) + ("\n" if k % 2 else ""), 12, 2)
