"""Word lists that the label and feature rules look up: one Russian pack per feature generation and a small English one."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Lexicon:
    """Phrases are matched as whole words of normalised text, ``*_stems`` at the beginning of a word."""

    function_words: tuple[str, ...]
    uncertainty: tuple[str, ...]
    yes_no: tuple[str, ...]
    person: tuple[str, ...]
    date: tuple[str, ...]
    number: tuple[str, ...]
    location: tuple[str, ...]
    yesno_openers: tuple[str, ...]
    reason: tuple[str, ...] = ()
    hedging: tuple[str, ...] = ()
    explanation: tuple[str, ...] = ()
    month_stems: tuple[str, ...] = ()
    months: tuple[str, ...] = ()
    ordinal_stems: tuple[str, ...] = ()
    ordinals: tuple[str, ...] = ()
    clause_words: tuple[str, ...] = ()
    refusal_tails: tuple[str, ...] = ()
    answer_prefix: str = "Answer"
    units: tuple[str, ...] = ()
    hard_questions: tuple[str, ...] = ()
    templates: dict[str, str] = field(default_factory=dict, hash=False)


# They must equal the reference's for equal results.
_RU_FUNCTION_WORDS = (
    "а", "без", "более", "бы", "в", "во", "все", "для", "до", "его", "ее", "её", "же", "за", "и", "из", "или", "им", "их", "к",
    "как", "ко", "ли", "на", "над", "не", "но", "о", "об", "обо", "около", "он", "она", "оно", "они", "от", "по", "под", "при",
    "про", "с", "со", "так", "то", "у", "это", "эта", "этот", "эти",
)
_RU_UNCERTAINTY = ("не знаю", "не могу", "не удалось", "не указано", "не сказано", "не упоминается", "нет информации", "недостаточно информации", "не могу ответить")
_RU_TEMPLATES = {
    "qa": "Ответь на вопрос по данному контексту кратко и строго по фактам из контекста. Если в контексте нет ответа, напиши 'не знаю'.\n\nЗаголовок: {title}\n\nКонтекст:\n{context}\n\nВопрос: {question}\nОтвет:",
    "entity_swap": "Сгенерируй краткий, уверенный, но неверный ответ, подменив ключевую сущность, имя, страну, город, организацию или объект на похожий.",
    "date_number_swap": "Сгенерируй краткий, уверенный, но неверный ответ, подменив дату, год, число, количество или сумму на правдоподобное, но неверное.",
    "cause_fact_swap": "Сгенерируй краткий, уверенный, но неверный ответ, подменив причину, факт, характеристику или итог на соседний, но неправильный.",
    "off_context_confident": "Сгенерируй краткий, уверенный, но неверный ответ, который звучит правдоподобно, но не подтверждается данным контекстом.",
    "false_refusal": "Сгенерируй ответ в стиле 'не знаю' или 'в контексте нет ответа', даже если правильный ответ в контексте есть.",
    "rule:entity_swap": "Замени сущность, но сохрани длину и формат ответа близкими к правильному.",
    "rule:date_number_swap": "В ответе обязательно используй цифры. Не пиши пояснение о том, что число было изменено.",
    "rule:cause_fact_swap": "Не добавляй кавычки, комментарии и мета-объяснения.",
    "rule:off_context_confident": "Дай уверенный ложный факт одной строкой без оговорок.",
    "rule:false_refusal": "Ответ должен быть именно отказом и содержать одну из формулировок: не знаю, в контексте нет ответа, это не указано в контексте.",
}
RU_V1 = Lexicon(
    function_words=_RU_FUNCTION_WORDS,
    uncertainty=_RU_UNCERTAINTY,
    yes_no=("да", "нет"),
    person=("кто", "кем", "кого", "кому"),
    date=("когда", "в каком году", "в каком веке", "какого года", "в каком месяце"),
    number=("сколько", "какое количество", "какова численность", "какой процент"),
    location=("где", "в какой стране", "в каком городе", "на каком острове", "в каком регионе"),
    yesno_openers=("верно ли", "правда ли", "является ли", "был ли", "была ли", "было ли"),
    clause_words=("потому что", "так как", "который", "которая", "которые", "поскольку"),
    refusal_tails=("не знаю", "не могу ответить", "в контексте нет ответа"),
    answer_prefix="Ответ",
    units=("года", "лет", "км", "млн", "млрд", "тысяч", "человек"),
    hard_questions=("сколько", "когда", "какой год", "в каком", "кто основал", "кто первый", "сколько раз", "какова", "каков"),
    templates=_RU_TEMPLATES,
)
RU_V2 = replace(
    RU_V1,
    person=(*RU_V1.person, "чей"),
    date=(*RU_V1.date, "какого числа", "в каком десятилетии"),
    number=(*RU_V1.number, "какой номер", "скольких"),
    location=(*RU_V1.location, "в какой области"),
    yesno_openers=(*RU_V1.yesno_openers, "можно ли"),
    reason=("почему", "зачем", "по какой причине"),
    hedging=("возможно", "вероятно", "предположительно", "по некоторым данным", "считается", "как правило", "обычно", "может"),
    explanation=("потому что", "так как", "который", "которая", "которые", "поскольку", "это связано"),
    month_stems=("январ", "феврал", "март", "апрел", "июн", "июл", "август", "сентябр", "октябр", "ноябр", "декабр"),
    months=("май", "мая"),
    ordinal_stems=("перв", "втор", "трет", "четверт", "пят", "шест", "седьм", "восьм", "девят", "десят"),
)
RU_V3 = replace(RU_V2, number=(*RU_V2.number, "скольким"), ordinals=("какой по счету", "какой по счёту", "какое место"))
# End of fixed values.

#: For texts without Cyrillic, such as the test tables: ours, not the reference's.
EN = Lexicon(
    function_words=("a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with"),
    uncertainty=("do not know", "not sure", "no information", "cannot answer"),
    yes_no=("yes", "no"),
    person=("who", "whom", "the"),
    date=("when", "what year", "this"),
    number=("how many", "how much", "that"),
    location=("where", "which country", "with"),
    yesno_openers=("is it", "was", "is", "in"),
    reason=("why", "for"),
    hedging=("perhaps", "maybe", "as"),
    explanation=("because", "which", "that"),
    month_stems=("januar", "februar", "mar", "apr", "sept"),
    months=("may",),
    ordinal_stems=("first", "second", "third", "th"),
    ordinals=("which place",),
    clause_words=("because", "which", "and"),
    refusal_tails=("i do not know", "cannot answer"),
    units=("years", "km"),
    hard_questions=("how many", "when", "the"),
    templates={"qa": "Answer from the context only.\n\nTitle: {title}\n\nContext:\n{context}\n\nQuestion: {question}\nAnswer:"} | {k: f"Give a wrong answer ({k})." for k in ("entity_swap", "date_number_swap", "cause_fact_swap", "off_context_confident", "false_refusal")},
)
PACKS = {"ru": RU_V3, "ru_v1": RU_V1, "ru_v2": RU_V2, "ru_v3": RU_V3, "en": EN}
