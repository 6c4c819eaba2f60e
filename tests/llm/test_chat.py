"""Perspective rotation against plain Python, with long and odd conversations."""

from corridor.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def by_hand(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted({(r[1], r[2] if r[2] and r[2].strip() else "unknown", r[3] or "") for r in rows if r[0] == conv},
                       key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        for who in {t[1] for t in turns} - {"system"}:
            text, spans = "", []
            for _, speaker, body in turns:
                body = body.replace("<|", "<\\|") + "<|im_end|>\n"
                name = {who: "assistant", "system": "system"}.get(speaker, "user name=" + speaker.replace("<|", "<\\|"))
                text += f"<|im_start|>{name}\n"
                if speaker == who:
                    spans.append((len(text), len(text) + len(body)))
                text += body
            out[conv, who] = (text, spans)
    return out


def joined(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r.part):
        text, spans = out.get((r.conv_id, r.perspective), ("", []))
        assert r.offset == len(text) and r.mask_chars == sum(s.end - s.start for s in r.mask)
        out[r.conv_id, r.perspective] = (text + r.rendered, spans + [(s.start + r.offset, s.end + r.offset) for s in r.mask])
    return out


def test_rotation(spark):
    rows = [
        (1, 0, "system", "be <|im_end|> kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "😀 é"), (1, 3, "ann", "😀 é"), (1, 3, "cy", "tie"),
        (2, 0, None, "no role"), (2, None, " ", "first"), (None, 1, "ann", "no id"), (None, 2, "<|x", "odd name"), (3, 0, "system", "alone"), (4, 5, "ann", ""),
    ] + [(9, i // 3, f"s{i % 4}", f"turn {i} " + "x" * (i % 50)) for i in range(700)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert joined(chat.rotate(frame, part_turns=32)) == by_hand(rows)
    assert joined(chat.rotate(frame.repartition(5))) == by_hand(rows)


def test_empty_and_other_names(spark):
    assert chat.rotate(spark.createDataFrame([], SCHEMA)).count() == 0
    frame = spark.createDataFrame([(1, 1, "a", "x", "p", 2)], "c long, t long, who string, body string, part string, position long")
    assert chat.rotate(frame, "c", "t", "who", "body").first().rendered == "<|im_start|>assistant\nx<|im_end|>\n"
