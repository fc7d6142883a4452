import numpy as np
import pytest

from strandline.llm import mojibake

SENTENCES = [
    "Nhóm lưu trữ muốn thêm một cột cho độ nét, nhưng ảnh vẫn mờ.",
    "Sau 55 lần thử, người dùng đã bỏ qua tệp này và chuyển nó xuống cuối hàng đợi.",
    "L’opérateur préfère les images nettes, même après 5 essais à côté du théâtre.",
    "Der Prüfer möchte 10 zusätzliche Bilder für die Übersicht, größer als früher.",
    "La señal cayó a las 02:14; según el técnico, también faltó la mitad.",
    "A seleção manteve 48 cenas e a visão não foi concluída até amanhã.",
    "That’s the “best” frame… — keep it • «now» ½ × 3.",
]
CLEAN = [
    *SENTENCES,
    "Оператор проверил 136 кадров, но резкость осталась ниже. «Камера» стояла у моста…",
    "Η κάμερα σταμάτησε στις 02:24:42, Ω = 2.67.",
    "Ærø-Fähre, Þór und Ðakovo: 21 Bilder, Ø 18.34 s. (± 3 °C) • m² ½ ×",
    "50枚の画像を保存しました。カメラの設定を確認してください（しきい値 1.123）。",
    "화면이 어두워졌습니다. 장면 16개.",
    "│   ├── 26.jpg\n│   └── Fevepra_24.png",
    "HÃY KIỂM TRA LẠI ĐỘ NÉT CỦA CẢNH 13. ATENÇÃO: A GRAVAÇÃO NÃO FOI CONCLUÍDA",
    "Vérifiez l’état, l’écran et l’été «à» l’École",
    "thx! much better 🎉 👍 → ok ≤ 5 ≠ 6 ∞ € 5",
    "plain ascii, it's fine -- really",
    "​ zero\xa0width  and \xadhyphen",
]


def garble(text, true, wrong):
    out = []
    for b in text.encode(true):
        try:
            out.append(bytes([b]).decode(wrong))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def restored(text):
    return mojibake.label_batch([text], mojibake.Labeller())[0][:3]


@pytest.mark.parametrize("text", CLEAN + [__import__("unicodedata").normalize("NFD", s) for s in SENTENCES])
def test_correct_text_is_no_case(text):
    assert restored(text) == (text, [], 0)


@pytest.mark.parametrize("wrong", mojibake.WRONG)
@pytest.mark.parametrize("text", SENTENCES)
def test_utf8_read_as_one_byte(text, wrong):
    broken = garble(text, "utf-8", wrong)
    got, states, n = restored(f"before it, {broken} and after it")
    assert n and got == f"before it, {text} and after it"


@pytest.mark.parametrize("text", SENTENCES[:2])
def test_decoded_wrongly_twice(text):
    got, _, n = restored(garble(garble(text, "utf-8", "cp1252"), "utf-8", "cp1252"))
    assert n and got == text


@pytest.mark.parametrize("wrong", [e for t, e in mojibake.SWAPPED if t == "cp1252"])
@pytest.mark.parametrize("text", [SENTENCES[3], SENTENCES[4], SENTENCES[5]])
def test_one_byte_read_as_another(text, wrong):
    broken = text.encode("cp1252").decode(wrong, "replace")
    got, _, n = restored(broken)
    assert n
    same = sum(a == b for a, b in zip(got, text)) / len(text)
    assert len(got) == len(text) and same >= 0.97


def test_utf16():
    text = "The preview cap was measured at a width of 17 px and isn’t it"
    raw = text.encode("utf-8")
    got, _, n = restored((raw + b" " * (len(raw) % 2)).decode("utf-16-le"))
    assert n and got.strip() == text


def test_lost_characters():
    got, states, n = restored("Il a fallu r�gler le seuil")
    assert n == 1 and states == ["lost"] and got == "Il a fallu r�gler le seuil"
    got, states, n = restored("NgÆ°á»�i dÃ¹ng nÃªn thá»\xad")
    assert n and "dùng nên thử" in got


def test_table(spark):
    rows = [(1, "chá»\x8dn tá»‰ lá»‡", "x"), (2, None, None), (3, "", ""), (4, "ok " * 100_000, ""), (5, "Ã©" * 5_000, ""), (None, "Â« tá»‰ lá»‡ Â»", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, states string")
    got = {r["doc_id"]: r for r in mojibake.find_wrong_decoding(df, "doc_id", "text").collect()}
    assert got[1]["restored"] == "chọn tỉ lệ" and got[1]["states"] == ["utf8-as-cp1252"]
    assert got[5]["restored"] == "é" * 5_000 and got[None]["n_stretches"] > 0
    assert all(got[k]["n_stretches"] == 0 and got[k]["restored"] is None for k in (2, 3, 4))
    assert mojibake.find_wrong_decoding(df, "doc_id", "text", only_found=True).count() == 3
    assert mojibake.find_wrong_decoding(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        mojibake.find_wrong_decoding(df, "states", "text")


RUSSIAN = [
    "Оператор проверил сотни кадров, но резкость осталась ниже обычной.",
    "Камера стояла у моста, поэтому первые кадры получились тёмными.",
    "Не сравнивайте Обрезанные снимки с целыми кадрами.",
]


@pytest.mark.parametrize("true, wrong", [p for p in mojibake.SWAPPED if p[0] != "cp1252"])
def test_cyrillic_in_another_encoding(true, wrong):
    """Every sentence is found; at least nine tenths of the words come back."""
    words = right = 0
    for text in RUSSIAN:
        got, states, n = restored(f"note 5: {garble(text, true, wrong)} end")
        assert n, text
        mine = f"note 5: {text} end".split()
        words += len(mine)
        right += sum(a == b for a, b in zip(mine, got.split()))
    assert right >= 0.9 * words


@pytest.mark.parametrize("text", RUSSIAN)
def test_correct_russian_is_no_case(text):
    assert restored(text) == (text, [], 0)


@pytest.mark.parametrize("wrong", ["cp1252", "latin_1"])
@pytest.mark.parametrize("times", [1, 2, 3, 4, 5, 6])
def test_any_number_of_times(times, wrong):
    text = broken = SENTENCES[2]
    for _ in range(times):
        broken = garble(broken, "utf-8", wrong)
    got, _, n, left = mojibake.label_batch([broken], mojibake.Labeller())[0]
    assert n and got == text and left == 0


def test_what_stays_is_counted():
    got, states, n, left = mojibake.label_batch(["a \ufffd\ufffd b cafÃ©"], mojibake.Labeller())[0]
    assert got == "a \ufffd\ufffd b café" and left == 1 and n == 2


def test_plain_stretches_change_no_path():
    """Leaving plain stretches out gives the path of the whole sequence in which every state emits them at one cost."""
    rng = __import__("random").Random(4)
    for _ in range(40):
        parts = []
        for s in rng.sample(SENTENCES, 3):
            for w in s.split():
                parts.append(garble(w, "utf-8", rng.choice(["cp1252", "cp437"])) if rng.random() < 0.3 else w)
        text = " ".join(parts)
        labeller = mojibake.Labeller()
        steps, spans = [], []
        for a, z in mojibake._stretches(text):
            cost, back, plain = labeller._cost(mojibake._context(text[a - 1]) if a else "", text[a:z], mojibake._context(text[z]) if z < len(text) else "")
            steps.append(np.full(len(mojibake.STATES), cost[0]) if plain else cost)
            spans.append((a, z, plain))
        best, ways = steps[0] + mojibake._CHANGES[0], []
        for cost in steps[1:]:
            all_ = best[:, None] + mojibake._CHANGES
            ways.append(all_.argmin(0))
            best = all_.min(0) + cost
        least = best.min()
        kept = [c for c, s in zip(steps, spans) if not s[2]]
        short = kept[0] + mojibake._CHANGES[0]
        for cost in kept[1:]:
            short = (short[:, None] + mojibake._CHANGES).min(0) + cost
        plain_cost = sum(c[0] for c, s in zip(steps, spans) if s[2])
        # The first plain stretches may come before any state is entered, at the same cost.
        assert abs(short.min() + plain_cost - least) < 1e-6
