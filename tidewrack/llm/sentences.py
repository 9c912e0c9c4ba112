"""Sentence boundaries across languages and scripts.

A text is cut into blocks (paragraphs, list entries), and every block is a lattice:
its nodes are the places where a sentence may end, an edge is a sentence between
two of them, and the cheapest path is the segmentation. What may end a sentence is
a terminator, a blank in Thai, and in Chinese or Japanese also a gap without any
mark. Every such place has a score, the evidence that a sentence ends there; a path
pays for ending against the evidence and for passing over it, and for every quote or
bracket it breaks open.

*Terminator lattice* (spaced scripts): the score adds up what the token before the
mark is (abbreviation, initial, unit, number, label, word), what follows (case, opener, blank
or none), and whether the sentence opens with the quote that closes here.

*Word lattice* (Thai, Chinese, Japanese): the runs on both sides of a gap are segmented
by a dictionary, by the cheapest path over its words and unknown letters. The gap is
classified by the word that ends its left side (a final particle, or a linker that
cannot end anything) and the word that opens its right side (an opener, or a word that
goes on with what was said). So a blank after `พื้นที่` ends a sentence although one
after `ที่` does not, and a quote before `とても` stands alone although one before `と` does not.

The script is judged around each gap, not per document, so mixed and mislabelled
texts work. Everything is a function of one text, run over Arrow batches without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Abbreviations that a sentence does not end with (lower case, without the last stop).
ABBREVIATIONS = frozenset("""
abb abs acad al anm app approx aprox art bd bl.a bzw ca cap cf ch co col comp dept d.h dgl dr dra dvs ed eds e.g eq eqs env esp est etw ev evtl
ex exp f.eks fig figs fr ggf gen hr hrsg i.e inkl inst jf jun kap lic lt maj max mgr mlle mme mr mrs ms mt mts n.b no nos nr núm num o.g
op osv p p.ej p.ex pág págs par pl pp prof pt pto ref refs resp rev s sect sec sgt sog sr sra sras srta st sta ste str suppl t.ex tab tel proc vis inst univ publ avg std u.a usw
vedr verf vgl viz vol vols vs w.o z.b z.t zit zw
г-н г-жа гл др им каф кв напр обл пер пр проф рис руб см соч ср ст стр т.е т.д табл тел тыс ул
αρ αριθ βλ δηλ δρ εικ κεφ κα κος μ.χ π.μ π.χ πίν σελ στ σχ τηλ
डॉ प्रो श्री सं मि.ग्रा मि कि.मी ई.पू
""".split())  # fmt: skip
# Abbreviations that end a sentence if a new one opens after them.
CLOSING_ABBREVIATIONS = frozenset("a.m p.m u.s u.k u.s.a e.u etc inc ltd corp jr sen bros ff sp spp nov др г гг ч мин сек млн млрд h min s m km cm mm kg g mg l ml yr yrs hrs sek pst ant".split())
# Month names, before which a number with a stop is a day.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember januari februari mars maj juli augusti oktober desember enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre janvier février avril juin juillet août septembre octobre novembre décembre january february march may june july october december".split())
# Nouns after which a single letter is a label, not an initial.
LABELS = frozenset("unit valve frame lamp tank option clause section group class type level part annex appendix figure table point grade vitamin phase series plate panel box station site zone line version trench gate sample stage step case schedule area block form bay bin row column lot plot pool cell cage rig buoy dock pier model method stufe klasse gruppe teil anhang wanne boje tafel ventil zone groupe classe annexe partie unité vanne grupo clase anexo parte unidad válvula gruppe del vedlegg класс группа часть приложение".split())
#: Words before a heading's number.
_LABEL = re.compile(r"(?:\d{1,2}(?:\.\d{1,2})*\.?|[IVXLC]+\.|\([a-zA-Z0-9]{1,3}\)|(?:Table|Tab|Figure|Fig|Annex|Appendix|App|Box|Section|Chapter|Part|Plate|Tabelle|Abbildung|Abb|Anhang|Kapitel|Tableau|Annexe|Chapitre|Tabla|Figura|Anexo|Capítulo|Tabell|Figur|Vedlegg|Таблица|Рис|Рисунок|Приложение|Глава|Πίνακας|Εικόνα|Παράρτημα)\.?\s+[\w.]+[.:])\s+(?=\S)")
_LIST = re.compile(r"\n[^\S\n]*[-–—•*·◦▪‣‐‑][^\S\n]+(?=\S)")
_NUMBERED = re.compile(r"\n[^\S\n]*\(?(?:\d{1,3}|[a-zA-Z])[.)][^\S\n]+(?=\S)")
_PARAGRAPH = re.compile(r"[^\S\n]*\n[^\S\n]*\n\s*")

# Words of scripts without spaces, by what they say about the gap beside them.
# OPENERS begin a sentence, LINKERS cannot end one, FINALS end one, REPORTS go on from a closed quote.
OPENERS = frozenset("ก่อนหน้านี้ จากนั้น ดังนั้น นอกจากนี้ อย่างไรก็ตาม แต่ เมื่อ ต่อมา ทั้งนี้ ขณะเดียวกัน ในที่สุด อนึ่ง 但是 然而 因此 此外 同时 另外 随后 最后 首先 其次 不过 所以 我们 本文 しかし また そして さらに この その これ それ ただし なお 一方 次に まず 最後に".split())
LINKERS = frozenset("และ หรือ ของ ใน ที่ จาก กับ เป็น คือ เพื่อ โดย ถึง ต่อ ซึ่ง เพราะ ตาม บน ด้วย ว่า 的 和 与 及 或 在 对 从 把 被 向 は が を に の と で へ も から まで より".split())
FINALS = frozenset("แล้ว ครับ ค่ะ นะ เลย ด้วยกัน เท่านั้น 了 吗 吧 呢 啊 だ です ます た か ね よ である ました でした ません だった いる ある する した".split())
REPORTS = frozenset("と の って という との".split())
REPEATS = frozenset("ๆ ฯ ฯลฯ".split())
# Other words of everyday and technical use, which keep the words above from being read out of them.
WORDS = frozenset("""
พื้นที่ ที่สุด ที่นี่ ที่นั่น ทันที หน้าที่ เจ้าหน้าที่ สถานที่ แผนที่ คงที่ เต็มที่ กะทันหัน ภายใน ภายนอก ในขณะที่ ของเสีย สิ่งของ ปะการัง น้ำลึก น้ำ ตะกอน ปกคลุม นาน ชั่วโมง นาที
ความขุ่น ความ การ สูง มิลลิกรัม ลิตร กระแสน้ำ อ่อน มาก ฤดูหนาว ฟองน้ำ ลด เพิ่ม อัตรา สูบ ลง ขึ้น ร้อยละ นักวิจัย เก็บ ตัวอย่าง ชิ้น ปี โพลิป หดตัว จึง ฟื้นตัว
ทะเล ผล ผลกระทบ การศึกษา พบ ว่าง ต่อเนื่อง ต่อไป โดยเฉพาะ โดยทั่วไป ถึงแม้ มาตรฐาน ตามปกติ ตามธรรมชาติ นะคะ
珊瑚 海绵 沉积物 悬浮物 浓度 达到 持续 钻屑 覆盖 采集 样本 附近 下降 水流 很弱 日志 写道 能见度 太差 观察员 记录 承受 多少 了解 为了 除了 罢了 目的 的确 现在 存在 正在 所在 在于 和平 和谐 总和 与其 参与 给与 从事 从而 自从 对于 对照 针对 相对 及时 以及 或者 或许 把握 被动 方向 方面 底部
とても ところ とき とも として とりわけ とくに どれほど のち のみ のど もの ものの ここ そこ どこ なんと 流れ 弱い 観測員 記録 濁度 超え 続い 回復 時間 要し 海綿 ろ過 速度 低下 採集 個体 サンゴ 堆積物 耐え られる 濁っ 海 図 参照 沖 日間 から見て までに でも では には とは ながら ために について によって において はず はじめ がら かなり からだ にわたり へこむ もっと もし もちろん よく より多く かつて たち たとえば ため
""".split())  # fmt: skip
#: What an unknown letter of a run costs, a dictionary word costing 1.
UNKNOWN = 1.6

#: What a path pays for every quote or bracket that it breaks open: more than for passing over three certain ends.
BREAK = 14.0
# Scores of what speaks for (positive) or against an end.
CERTAIN, LIKELY, WEAK = 4.0, 2.0, 1.0

_OPEN = "“„«「『‘‚([（【《〈｢"
_CLOSE = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "〈": "〉", "｢": "｣"}
_QUOTES = frozenset("“„«「『\"｢")
_CLOSERS = "”“»」』\"'’)]）】》〉｣"
_PAIR = re.compile(r"[“”„«»「」『』\"()\[\]（）【】《》〈〉｢｣]")
#: What no token holds, beside blanks.
_NO_TOKEN = frozenset("“”„«»「」『』\"()[]（）,;:，、：")
_AFTER = re.compile(r"\w[\w.\-]{0,40}")
_URL = re.compile(r"(?:https?://|www\.)[^\s“”«»\"<>，。]*[^\s“”«»\"<>，。.,;:!?)]|\b[\w.+-]+@[\w-]+\.[\w.-]*\w")
_INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad"
_THAI = re.compile(r"[\u0e00-\u0e7f]")
_KANA_HAN = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f"
_CJK = re.compile(f"[{_KANA_HAN}]")
_GREEK = re.compile(r"[\u0370-\u03ff\u1f00-\u1fff]")
_BLANK = re.compile(r"\s")
_RUN = re.compile(f"[\u0e00-\u0e7f]+|[{_KANA_HAN}]+")
_TERMINATOR = "[.!?…。！？｡．।॥؟۔;⁇⁈⁉]+"
_MARK = re.compile(_TERMINATOR)
#: With the gaps of scripts without spaces, for texts that hold any.
_GAP_OR_MARK = re.compile(_TERMINATOR + r"|(?<=[\u0e00-\u0e7f])\s+|\s+(?=[\u0e00-\u0e7f])" + f"|(?<=[{_KANA_HAN}])\\s+(?=[{_KANA_HAN}])")
#: Thai letters that do not stand without the one before them.
_BOUND = frozenset("ะัาำิีึืฺุู็่้๊๋์ํ๎ๅ")
#: A token longer than any abbreviation, unit or number is a plain word, whatever it is.
_LONG = 48


class Words:
    """The word lattice: the first and last word of any run of a script without spaces."""

    def __init__(self, dictionary: frozenset[str] = OPENERS | LINKERS | FINALS | REPORTS | REPEATS | WORDS):
        self.dictionary = dictionary
        self.longest = max(map(len, dictionary), default=0)

    def segment(self, run: str) -> list[str]:
        """The run as words, by the cheapest path: a dictionary word costs 1, any other letter ``UNKNOWN``."""
        n = len(run)
        best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for a in range(n):
            if a and run[a] in _BOUND:
                continue
            b = a + 1
            while b < n and run[b] in _BOUND:
                b += 1
            if best[a] + UNKNOWN < best[b]:
                best[b], back[b] = best[a] + UNKNOWN, a
            for b in range(a + 1, min(n, a + self.longest) + 1):
                if run[a:b] in self.dictionary and not (b < n and run[b] in _BOUND) and best[a] + 1.0 < best[b]:
                    best[b], back[b] = best[a] + 1.0, a
        words, at = [], n
        while at:
            words.append(run[back[at] : at])
            at = back[at]
        return words[::-1]


class _Text:
    """One block and what its gaps are judged by, each found in one pass."""

    def __init__(self, text: str, words: Words):
        self.text, self.words = text, words
        self.pairs = _pairs(text)
        self.opened = {a: (b, quote) for a, b, quote in self.pairs}
        self.closes = {b for _, b, _ in self.pairs}
        self.runs: dict[int, list[str]] = {}
        self.run_from: dict[int, tuple[int, int]] = {}
        for m in _RUN.finditer(text):
            self.run_from[m.start()] = self.run_from[-m.end()] = m.span()

    def _segmented(self, span: tuple[int, int]) -> list[str]:
        if span[0] not in self.runs:
            self.runs[span[0]] = self.words.segment(self.text[span[0] : span[1]])
        return self.runs[span[0]]

    def word_before(self, at: int) -> str:
        """The last word of the run that ends at ``at``; '' if the dictionary does not have it."""
        span = self.run_from.get(-at)
        word = self._segmented(span)[-1] if span else ""
        return word if word in self.words.dictionary else ""

    def word_after(self, at: int) -> str:
        """The first word of the run that begins at ``at``; '' if the dictionary does not have it."""
        span = self.run_from.get(at)
        word = self._segmented(span)[0] if span else ""
        return word if word in self.words.dictionary else ""


def _pairs(text: str) -> list[tuple[int, int, bool]]:
    """Matched quotes and brackets as (open, close, is quote), by where they open; what has no partner is ignored.

    Of every mark its open places are kept apart, so each step costs as much as it closes.
    """
    stack: list[tuple[str, int]] = []
    waiting: dict[str, list[int]] = {}
    found = []
    for m in _PAIR.finditer(text):
        c, at = m.group(), m.start()
        opener = max((o for o in _CLOSE if c in _CLOSE[o] and waiting.get(o)), key=lambda o: waiting[o][-1], default=None)
        if c == '"':
            opener = c if waiting.get(c) else None
        if opener is not None:
            k = waiting[opener][-1]
            found.append((stack[k][1], at, opener in _QUOTES))
            while len(stack) > k:
                waiting[stack.pop()[0]].pop()
        elif c == '"' or c in _OPEN:
            waiting.setdefault(c, []).append(len(stack))
            stack.append((c, at))
    return sorted(found)


def _opens(text: str, at: int) -> bool | None:
    """Whether what stands at ``at`` opens a sentence: True, False (lower case), or None where script has no case."""
    while at < len(text) and text[at] in _INVISIBLE:
        at += 1
    c = text[at : at + 1]
    if c.islower():
        nxt = text[at + 1 : at + 2]
        return nxt.isupper() and nxt.isalpha()  # eDNA, pH
    if c.isupper() or c.istitle() or c.isdigit() or c in "¿¡" or c in _OPEN or c in "\"'-–—±":
        return True
    return None if c.isalpha() else c not in ",;:)%]/"


def _gap_score(block: _Text, left: int, right: int) -> float:
    """Whether a blank between two runs of a script without spaces ends a sentence, by the words beside it."""
    text = block.text
    before, after = block.word_before(left), block.word_after(right)
    finals = (before in FINALS) + (after in OPENERS)
    if _THAI.match(text[left - 1 : left]) or _THAI.match(text[right : right + 1]):
        if text[left - 1 : left] in ".!?":
            return -CERTAIN  # the mark itself is judged
        return LIKELY + LIKELY * finals - 2 * CERTAIN * (before in LINKERS) - 2 * CERTAIN * (after in REPEATS) - (LIKELY + WEAK) * (before in REPEATS)
    return -LIKELY - WEAK + LIKELY * finals - CERTAIN * (before in LINKERS)


def _full_stop(block: _Text, token: str, mark: int, after: int, blank: bool, closed: bool, opens: bool | None) -> float:
    """The score of one full stop after ``token``."""
    text = block.text
    for c in _INVISIBLE:
        if c in token:
            token = token.replace(c, "")
    low = token.lower().lstrip("'’‘-–")
    number = bool(re.fullmatch(r"\d+(?:[.,:]\d+)*", low)) or low.replace("-", "").isdigit()
    word = _AFTER.match(text, after)
    month = bool(word) and word.group().lower() in MONTHS
    back = lambda n: text[max(0, mark - len(token) - n) : max(0, mark - len(token))].rstrip()
    if opens is False:
        # Lower-cased text: only a plain word, a number that is no day, or a label lets a sentence end here.
        if not blank or closed:
            return -CERTAIN
        if low in ABBREVIATIONS or low in CLOSING_ABBREVIATIONS or re.search(r"[\u0900-\u097f]", low):
            return -CERTAIN
        if len(low) == 1:
            return WEAK if back(20).split(" ")[-1].lower() in LABELS else -CERTAIN
        if re.fullmatch(r"\w*\d[\d.,:]*%?", low):
            return -CERTAIN if month else WEAK
        return WEAK if len(low) > 2 and low.replace("-", "").replace("'", "").replace("’", "").isalpha() else -LIKELY
    score = LIKELY if blank or closed else -CERTAIN
    if not blank and not closed:
        nxt = text[after : after + 2]
        capital = nxt[:1].isupper() and (nxt[1:].islower() or nxt[1:] == " " or nxt[1:].isspace())
        if capital or nxt[:1] in "¿¡“«„" or (nxt[:1] == '"' and after in block.opened):
            score += CERTAIN + LIKELY
        if (len(low) < 2 and not low.isdigit()) or "." in low or low in ABBREVIATIONS:
            kept = re.fullmatch(r"\d+(?:\.\d+)?%?", low) or (low in CLOSING_ABBREVIATIONS and low[-1:] in "ms")
            return score if kept else score - 2 * CERTAIN
        if score < 0:
            return score
    if low in ABBREVIATIONS and not (low in ("st", "no", "s") and closed):
        return score - 2 * CERTAIN
    if number:
        return score - 2 * CERTAIN if month else score
    if len(low) == 1 and low.isalpha():
        named = (token.islower() and back(14)[-1:].isdigit()) or back(14).split(" ")[-1].lower() in LABELS
        return score if named else score - CERTAIN
    if low in CLOSING_ABBREVIATIONS:
        if len(low) <= 3 and "." not in low and low not in ("etc", "inc", "ltd", "sp", "spp", "nov"):
            return score if back(12)[-1:].isdigit() or low in ("др", "etc") or len(low) > 2 else score - CERTAIN
        return score
    if re.fullmatch(r"(?:\w\.)+\w", low):
        ends = not token.islower() and len(low) <= 5 and token.replace(".", "").isupper() and not re.fullmatch(r"\w\.\w", token)
        return score if ends or (opens is True and low in CLOSING_ABBREVIATIONS) else score - CERTAIN
    if re.search(r"[\u0900-\u097f]\Z", token):
        return score - 2 * CERTAIN  # Devanagari ends sentences with a danda; its stops abbreviate
    return score


def _score(block: _Text, token: str, mark: int, run: str, at: int, after: int, blank: bool, closed: bool, held: bool, greek: bool) -> float:
    """Evidence that the marks ``run`` at ``mark`` end a sentence: above nought for, below against.

    ``after`` is where the text goes on, past closing quotes (up to ``at``) and blanks;
    ``held`` whether the sentence opens with the quote that closes here, ``greek`` whether
    it has a Greek letter.
    """
    text = block.text
    opens = _opens(text, after)
    first = run[0]
    wide = first in "。！？｡．।॥؟۔⁇⁈⁉"
    if wide or (first in "!?…" and _CJK.match(text[mark - 1 : mark] or " ") and (first != "…" or opens is not False)):
        score = CERTAIN if opens is not False or first in "।॥" else -LIKELY
        if closed:
            follows = block.word_after(after)
            if text[at - 1] in "」』":
                score -= 2 * CERTAIN * (follows in REPORTS)  # a Japanese report goes on with a particle
            elif held and (opens is not True or _CJK.search(text, after, after + 2) or (first in "。！？｡．" and text[at - 1] == "”" and not blank)):
                score -= 2 * CERTAIN  # the quote opens the sentence: who says it follows
        return score
    if first == ";":
        return LIKELY if opens is not False and blank and greek else -CERTAIN
    if first in "!?":
        if opens is False:
            return LIKELY if run[0] == run[-1] == "?" and blank and not closed else -CERTAIN
        return LIKELY + WEAK if blank or opens is True else -CERTAIN
    if first == "…" or run.startswith(".."):
        return LIKELY if opens is True and (blank or text[after].isupper() or text[after] in _QUOTES) else -CERTAIN
    if len(run) > 1 and opens is False:
        return -CERTAIN
    return _full_stop(block, token, mark, after, blank, closed, opens)


def _block(text: str, base: int, out: list[tuple[int, int]], words: Words) -> None:
    """Sentences of one block, whose first character stands at ``base``: the cheapest path through its lattice.

    A state of the path is its current sentence's start as far as that still matters:
    the quote it opens with, how many of the quotes and brackets around the mark it
    lies in, and the start itself while no blank has come. The cheapest way to each
    state is kept, so the number of states is bounded by the depth of nesting.
    """
    heading = _LABEL.match(text)
    guard = heading.end() if heading else 0
    block = _Text(text, words)
    size = len(text)
    urls = [m.span() for m in _URL.finditer(text)] if "http" in text or "www." in text or "@" in text else []
    url = pair = greek_at = 0
    greeks = [m.end() for m in _GREEK.finditer(text)] if ";" in text else []
    around: list[tuple[int, int, bool]] = []
    paths: list[tuple[float, int, tuple | None]] = [(0.0, 0, None)]  # cost, start, (cuts before, cut)
    for m in (_GAP_OR_MARK if block.run_from else _MARK).finditer(text):
        mark, end = m.span()
        run = m.group()
        if mark < guard or mark == 0 and run.isspace():
            continue
        while url < len(urls) and urls[url][1] <= mark:
            url += 1
        if url < len(urls) and urls[url][0] <= mark:
            continue
        while pair < len(block.pairs) and block.pairs[pair][0] < mark:
            around.append(block.pairs[pair])
            pair += 1
        if around:
            around = [p for p in around if p[1] >= mark]
        low = mark
        if run.isspace():
            at, after, closed, blank, greek = mark, end, False, True, -1
            gap: float | None = _gap_score(block, mark, end)
        else:
            at, gap = end, None
            # French sets a blank before the closing quote.
            while at < size and (text[at] in _CLOSERS or text[at] in _INVISIBLE or (text[at] in " \u00a0\u202f\u2009" and text[at + 1 : at + 2] in ("»", "”") and at + 1 in block.closes)):
                if text[at] in '"“' and at in block.opened:
                    break  # a quote that opens here belongs to what follows
                at += 1
            closed = at > end and any(c in _CLOSERS for c in text[end:at])
            after = at
            while after < size and (text[after].isspace() or text[after] in _INVISIBLE):
                after += 1
            if after >= size:
                break
            blank = any(c.isspace() for c in text[at:after])
            stop_at = mark - _LONG - 1 if mark > _LONG else 0
            while low > stop_at and not text[low - 1].isspace() and text[low - 1] not in _NO_TOKEN:
                low -= 1
            while greek_at < len(greeks) and greeks[greek_at] <= mark:
                greek_at += 1
            greek = greeks[greek_at - 1] if greek_at else -1
        still = [p for p in around if p[1] >= at] if around else around
        following: dict[tuple[int, int, int], tuple[float, int, tuple | None]] = {}
        ended: tuple[float, int, tuple | None] | None = None
        scores: dict[tuple[int, bool, bool], float] = {}
        for cost, start, before in paths:
            quote = block.opened.get(start)
            quoted = quote is not None and quote[1] and quote[0] >= mark
            begin = start if start > low else low
            if start > mark:
                score = -CERTAIN
            elif gap is not None:
                score = gap
            else:
                seen = (begin, quoted, greek >= start)
                if seen not in scores:
                    token = text[begin:mark] if mark - begin <= _LONG else "x" * _LONG
                    scores[seen] = _score(block, token, mark, run, at, after, blank, closed, quoted and closed, seen[2])
                score = scores[seen]
            if start <= mark:
                stop = cost + (-score if score < 0 else 0.0) + (BREAK * sum(1 for p in still if p[0] >= start) if still else 0.0)
                if ended is None or stop < ended[0]:
                    ended = (stop, after, (before, (start, at)))
            if score > 0:
                cost += score
            key = (start if quoted else -1, sum(1 for p in around if p[0] >= start) if around else 0, start if end - start <= _LONG and not _BLANK.search(text, start, end) else -1)
            if key not in following or cost < following[key][0]:
                following[key] = (cost, start, before)
        paths = list(following.values())
        if ended is not None:
            paths.append(ended)
        if len(paths) > 1:
            bound = min(p[0] for p in paths) + BREAK * (len(around) + 1) + 4 * CERTAIN
            paths = [p for p in paths if p[0] <= bound]
    _, start, before = min(paths, key=lambda p: p[0])
    cuts = [(start, size)] if start < size else []
    while before is not None:
        before, cut = before
        cuts.append(cut)
    for a, b in reversed(cuts):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((base + a, base + b))


#: The lattice with the whole dictionary, as used over tables.
DICTIONARY = Words()


def sentences(text: str | None, words: Words = DICTIONARY) -> list[tuple[int, int]]:
    """(start, end) of every sentence, heading and list entry, in code points, end exclusive, without outer blanks.

    Null, empty and blank texts have none. A text without any mark is one unit per
    block. Very long texts and blocks cost time in proportion to their length.
    """
    out: list[tuple[int, int]] = []
    if not text:
        return out
    at = 0
    while at <= len(text):
        found = _PARAGRAPH.search(text, at)
        end = found.start() if found else len(text)
        part, lists = text[at:end], None
        if "\n" in part or part[:1] in "-–—•*·◦▪‣‐‑":
            lists = [m.start() for m in _LIST.finditer("\n" + part)]
            if not lists and len(numbered := [m.start() for m in _NUMBERED.finditer("\n" + part)]) == part.count("\n") + 1 > 1:
                lists = numbered
        if lists:
            edges = [*([0] if lists[0] > 0 else []), *lists, len(part)]
            for a, b in zip(edges, edges[1:]):
                if a == 0 and lists[0] > 0:
                    _block(part[a:b], at + a, out, words)
                else:
                    s, e = at + a, at + b
                    while s < e and text[s].isspace():
                        s += 1
                    while e > s and text[e - 1].isspace():
                        e -= 1
                    if s < e:
                        out.append((s, e))
        elif part:
            lead = len(part) - len(part.lstrip())
            _block(part[lead:], at + lead, out, words)
        if not found:
            break
        at = found.end()
    return out


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_start, sent_end) of every sentence of every document.

    Rows with a null key come out under a null key; documents without text give
    no row; repeated rows repeat their sentences. Other columns are not read.
    """
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, rows = [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                for a, b in sentences(value):
                    rows.append(row)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], [key, "sent_start", "sent_end"])

    return documents.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, sent_start bigint, sent_end bigint")
