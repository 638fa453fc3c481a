"""Whether a line of a page is content or part of the page's controls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import let

#: Controls that occur inside content, removed in this order before it is judged; fixed values.
EMBEDDED = (
    r"Показать предыдущую страницу документа",
    r"Показать следующую страницу документа",
    r"Show previous page",
    r"Show next page",
    r"Поделиться\s*",
    r"Подписаться\s*",
    r"Версия официального сайта для мобильных устройств\s*",
    r"Текст\s*",
    r"ВКонтакте\s*Telegram\s*Одноклассники",
    r"VK\s*OK\s*Rutube",
    r"Официальные\s+сетевые\s+ресурсы",
    r"Президент\s+России",
    r"Администрация\s+Президента\s+России\s*\d{4}\s+год",
    r"Официальный\s+сайт\s+президента\s+России",
    r"Правовая\s+и\s+техническая\s+информация",
    r"Введите\s+корректый\s+Email",
    r"Government\.ru:Отправить",
    r"Спасибо\s*Внимание",
    r"Правительство\s+России",
    r"Председатель\s+Правительства",
    r"Вице-премьеры",
    r"Министерства\s+и\s+ведомства",
    r"Заголовок\s+или\s+текст\s+документа",
    r"Показать\s+еще",
    r"Маленький\s+размер\s+шрифта",
    r"Нормальный\s+размер\s+шрифта",
    r"Большой\s+размер\s+шрифта",
    r"Включить/выключить\s+отображение\s+изображений",
    r"Следующая\s+новость",
    r"Предыдущая\s+новость",
)
#: Whole lines, or parts of lines, that are controls, in the order in which they are tried; fixed values.
STANDALONE = (
    r"^Поделиться$",
    r"^(ВКонтакте|Telegram|Одноклассники|VK|OK|Rutube|YouTube)$",
    r"^Telegram-канал$",
    r"^Скопировать ссылку$",
    r"^Переслать на почту$",
    r"^Распечатать$",
    r"^Прямая ссылка на материал",
    r"^https?://\S+$",
    r"или по банку документов",
    r"^(События|Структура|Видео и фото|Документы|Контакты|Поиск)$",
    r"^(О портале|О сайте|Карта сайта)$",
    r"^Найти документ$",
    r"Информационные ресурсы",
    r"^(Название документа или его номер|Текст в документе)$",
    r"^Дата вступления в силу",
    r"^или дата принятия",
    r"^(Введите запрос|Искать на сайте|Найти)$",
    r"^Официальный портал правовой информации",
    r"^\d{4}\s+год\.?$",
    r"^Администрация Президента России",
    r"Для СМИ$",
    r"Специальная версия для людей с ограниченными возможностями",
    r"^(Конституция России|Государственная символика)$",
    r"Обратиться к Президенту",
    r"^Написать в редакцию$",
    r"Creative Commons Attribution \d\.\d",
    r"Все материалы сайта доступны по лицензии",
    r"^Электронная почта адресата$",
    r"^Отправить$",
    r"^Вы\s+пользуетесь\s+устаревшей",
)
#: Starts of headings of sections; fixed values.
SECTIONS = ("Раздел", "Глава", "Подраздел")
_SECTION_SIGN = r"^§\s+\d+\.?\s*[А-Яа-яЁёA-Za-z]"
_AMENDED_TITLE = r"^\d+\.\s+[А-Яа-яЁё].*\s*\(.*(?:дополнение| редакция| редакции| утратил).+\)"
_SPACE = " \t\n\r\f\v"


def content_validity(text: Column, embedded: tuple[str, ...] = EMBEDDED, standalone: tuple[str, ...] = STANDALONE) -> Column:
    """(ok, reason): the first rule that tells a line from content; the reason is null for content.

    ``embedded`` and ``standalone`` are a site's controls; the defaults know the common ones, a
    site's longer menus are passed in.
    """
    trimmed = lambda c: F.btrim(c, F.lit(_SPACE))

    def cleaned(whole: Column) -> Column:
        clean = whole
        for pattern in embedded:
            clean = F.regexp_replace(clean, f"(?iUd){pattern}", "")
        return F.struct(whole.alias("whole"), clean.alias("clean"))

    def judged(line: Column) -> Column:
        whole, clean = line["whole"], line["clean"]
        size = F.length(whole).cast("string")
        digits = F.length(F.regexp_replace(clean, "[^0-9]", "")) / F.length(clean)
        reason = F.when(whole == "", "empty_text").when(F.length(whole) < 10, F.concat(F.lit("too_short_"), size, F.lit("_chars"))).when(F.length(whole) > 5000, F.concat(F.lit("too_long_"), size, F.lit("_chars")))
        reason = reason.when(whole.rlike(f"^({'|'.join(SECTIONS)})"), "section_header").when(whole.rlike(_SECTION_SIGN), "section_symbol_header")
        reason = reason.when(whole.rlike(f"(?iUd){_AMENDED_TITLE}") & (F.length(whole) < 100), "subsection_title_with_amendment")
        reason = reason.when((clean != whole) & (F.length(trimmed(clean)) < 10), "cleaned_too_short")
        for pattern in standalone:
            reason = reason.when(clean.rlike(f"(?iUd){pattern}"), f"ui_pattern_{pattern[:20]}")
        return reason.when(digits > 0.4, F.concat(F.lit("high_digit_ratio_"), F.format_string("%.2f", digits)))

    reason = let(let(trimmed(F.coalesce(text, F.lit(""))), cleaned), judged)
    return let(reason, lambda r: F.struct(r.isNull().alias("ok"), r.alias("reason")))


def content_reason_sql(text: str) -> str:
    """SQL of the reason, null for content."""
    quote = lambda s: s.replace("'", "''")
    trimmed = lambda c: f"trim({c}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    whole = trimmed(f"coalesce({text}, '')")
    clean = whole
    for pattern in EMBEDDED:
        clean = f"regexp_replace({clean}, '(?i){quote(pattern)}', '', 'g')"
    controls = " ".join(f"WHEN regexp_matches(c, '(?i){quote(p)}') THEN 'ui_pattern_{quote(p[:20])}'" for p in STANDALONE)
    return f"""(SELECT CASE WHEN w = '' THEN 'empty_text' WHEN length(w) < 10 THEN concat('too_short_', length(w), '_chars') WHEN length(w) > 5000 THEN concat('too_long_', length(w), '_chars')
 WHEN regexp_matches(w, '^({'|'.join(SECTIONS)})') THEN 'section_header' WHEN regexp_matches(w, '{_SECTION_SIGN}') THEN 'section_symbol_header'
 WHEN regexp_matches(w, '(?i){_AMENDED_TITLE}') AND length(w) < 100 THEN 'subsection_title_with_amendment' WHEN c <> w AND length({trimmed('c')}) < 10 THEN 'cleaned_too_short' {controls}
 WHEN length(regexp_replace(c, '[^0-9]', '', 'g')) / length(c) > 0.4 THEN format('high_digit_ratio_{{:.2f}}', length(regexp_replace(c, '[^0-9]', '', 'g')) / length(c)) END FROM (SELECT {whole} AS w, {clean} AS c) t)"""
