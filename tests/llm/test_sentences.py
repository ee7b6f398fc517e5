import random

import pytest

from quarrymill.llm.sentences import Habits, _few, _many, _weights, blanks_end, blocks_of, cuts, sentences, spans
from quarrymill.session import table
from tests.compare import SF

# Each list joined by what stands between; the operator has to find the list again.
CASES = {
    "en": ("Dr. Alba asked, \"Is it ready? Are we sure?\" and closed it.| At 9 a.m. the U.S. mirror of Beta Inc. began.| We saw 3.5 of No. 60.| iPad clients need 3.3.5 or later.| Nobody told us...| The rest is fine!"),
    "quotes": ("He said: \"Stop it. Then wait 4 s.\" before it went on.| (The watcher ignores it.)| See 5 (it is slow!) and more.| Next one."),
    "de": ("„Läuft das? Wirklich?“, fragte Kim.| Prof. Ude kam am 12. Juni um 8.15 Uhr.| Das gilt z. B. für Nr. 5 bzw. 6 usw.| Ende."),
    "es": ("¿Funciona esto? |¡Nunca lo pares! |La Dra. Paz revisó aprox. 29 archivos, p. ej. uno.| Fin."),
    "zh": ("他们只说：“别停。也别动。”，小王照做了。|更新之后，版本是v4.11.0，每2.64秒一次。|为什么？！|小王喊道：“快走！”|小李的任务（如.md、.txt等）完成了。"),
    "zh half-width": ("先检查data/a.toml，再重启.|小王测试了约5个目录（如.md、.txt等），耗时36.48秒.|向conf/b.txt写一次data/c.txt.|分割器停了!|小李走了."),
    "ja": ("「止めないこと！」と彼は書いた。|彼は「止まった。消えた。」と言った。|終わり。"),
    "hi": ("डॉ. Rao ने पूछा, \"क्या यह तैयार है? पक्का?\" और बंद किया। |क्या यह हुआ? |conf/a.toml को रोकें। |अंत।"),
    "ar": ("سأل د. Rao: «هل هو جاهز؟ حقا؟»، ثم أغلق الملف. |هل انتهى خلال 5.4 ثانية؟ |لا تحذف!"),
    "th": ("ระบบจะเก็บ 80 รายการเพื่อรวม |ก่อนตรวจสอบให้หยุดแล้วเปิดอีกครั้ง |ทีมของ Rao ใช้เสมอ"),
    "zh blanks": ("夜间任务复制文件到data/a.md并校验 |如果超过78条请开启截断 |小王走了"),
}


def found(text, habits=None):
    out, own = [], list(blocks_of(text))
    for at, kind, block in own:
        out += [text[at + a : at + b] for a, b in spans(block, kind, blanks_end(own), habits or Habits([]))]
    return out


@pytest.mark.parametrize("name", CASES)
def test_languages(name):
    assert found(CASES[name].replace("|", "")) == [s.strip() for s in CASES[name].split("|")]


def test_blocks():
    text = "# Title. More\r\nPara one\r\ngoes on. Second\r\n\r\n- item one. And two\r\n  wrapped\r\n* other\r\n1. first\r\n2. second\r\n```py\r\nx = 1. Y\r\n```\r\n" + "A1b/" * 30 + "\r\n\r\nEnd without mark  "
    assert found(text) == ["# Title.", "More", "Para one\r\ngoes on.", "Second", "- item one.", "And two\r\n  wrapped", "* other", "1. first", "2. second", "A1b/" * 30, "End without mark"]


def test_a_number_in_wrapped_prose_is_no_item():
    assert found("Er kam am\n12. Juni um acht Uhr an.") == ["Er kam am\n12. Juni um acht Uhr an."]


def test_habits_learned_from_all_texts(spark):
    rows = [(i, f"The unit weighs 5 kgs. Basis number {i} holds. It is good.") for i in range(60)] + [(99, None), (98, ""), (97, " \n "), (96, "```\ncode. More\n```")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, body string, start_pos string").select("id", "body")
    by = {}
    for r in sentences(docs, "id", "body").collect():
        by.setdefault(r.id, []).append((r.start_pos, r.end_pos))
    assert set(by) == set(range(60)) and all(rows[i][1][a:b].strip() == rows[i][1][a:b] for i, own in by.items() for a, b in own)
    assert all(own[-1][1] == len(rows[i][1]) for i, own in by.items())
    assert sentences(docs.limit(0), "id", "body").count() == 0


def test_spans_part_a_long_block():
    text = "Word by word. " * 100_000
    assert len(found(text)) == 100_000


def test_far_beginnings_are_found():
    """One sentence over more ends than a stretch holds, none of which is one, between two others."""
    text = "It began. See " + "approx. x " * 900 + "and ended. Then came another."
    assert found(text) == ["It began.", text[10:-19].strip(), "Then came another."]


def test_few_and_many_ends_are_chosen_alike():
    rnd = random.Random(2)
    parts = ["Word goes.", "e.g. it", '"Say it.', 'End."', "(see", "this.)", "x. y", "No. 5", "long " * 150, "!", "Dr. Who", "“Why?”", "and so"]
    for _ in range(40):
        text = " ".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))
        cut = cuts(text, "text", False)
        weight = [_weights(text, c, Habits([])) for c in cut]
        assert list(_few(cut, weight, len(text.rstrip()))) == list(_many(cut, weight, len(text.rstrip())))


def test_habits_by_groups_as_by_all(spark):
    docs = table(spark, SF, "kb_documents").select("file_id", "content")
    whole = sorted(tuple(r) for r in sentences(docs, "file_id", "content").collect())
    assert sorted(tuple(r) for r in sentences(docs, "file_id", "content", most=3, group_blocks=50).collect()) == whole
