"""Word lists, tables and patterns of the Russian rule pack.

Fixed values: results depend on them, so they are stated as they have to be. Every operator takes its rules as an
argument; these are the defaults.
"""

from __future__ import annotations

# --- fixed values: stemming and stop words -----------------------------------------------------------------------
#: Endings that the stemmer takes off, longest first.
ENDINGS = "иями ями ами ого ему ому ыми ими ий ый ой ая яя ое ее ые ие ов ев ей ам ям ах ях ом ем а я ы и у ю е о".split()
STOP_WORK = "на в по для из под над при и или до от к".split()
STOP_TAXONOMY = [*STOP_WORK, "через"]
STOP_TABLE = [*STOP_WORK, "через", "устройство", "выполнение", "работы", "работ"]
STOP_AUDIT = "для при или под над без через комплект материал материалы оборудование изделие изделия".split()
STOP_SIGNATURE = "и в во на по с со для при до от к из а или что данного данной работ работы".split()

# --- fixed values: units and source priorities -------------------------------------------------------------------
TABLE_UNITS = {"м": "м", "пм": "п.м.", "погм": "п.м.", "м2": "м²", "м²": "м²", "м3": "м³", "м³": "м³", "км": "км", "шт": "шт", "штук": "шт", "компл": "компл.", "комплект": "компл.", "комплектов": "компл.", "комплекс": "компл.", "т": "т", "кг": "кг"}
MATERIAL_UNITS = {"шт": "шт", "штук": "шт", "м": "м", "п.м": "п.м.", "пм": "п.м.", "м²": "м²", "м2": "м²", "м³": "м³", "м3": "м³", "кг": "кг", "т": "т", "л": "л", "компл": "компл.", "комплект": "компл.", "упак": "упак.", "упаковка": "упак.", "рул": "рул.", "рулон": "рул."}
#: Unit of a quantity found in running text: the first pattern that matches anywhere.
QUANTITY_UNITS = [(r"п\.?\s*м\.?", "п.м."), ("м²|м2", "м²"), ("м³|м3", "м³"), ("км", "км"), ("м", "м"), (r"шт\.?|штук", "шт"), (r"компл\.?|комплект(?:ов|а)?", "компл."), ("т", "т"), ("кг", "кг")]
KNOWN_QUANTITY_UNITS = ["м", "п.м.", "м²", "м³", "км", "шт", "компл."]
SOURCE_PRIORITY = {"work-volume": 100, "schedule": 80, "specification": 60, "working-documents": 50, "estimate": 40, "cable-journal": 30, "explanatory-note": 20, "unknown": 10}
QUANTITY_PATTERN = r"(\d{1,3}(?:\s\d{3})*(?:[.,]\d+)?|\d+(?:[.,]\d+)?)\s*(п\.?\s*м\.?|м²|м2|м³|м3|км|м|шт\.?|штук|компл\.?|комплект(?:ов|а)?|кг|т)(?=\s|$|[.,;:)])"
INTENT_PHRASES = ["объем работ", "объём работ", "объем работы", "объём работы", "протяженность", "протяжённость", "общая длина", "длина трассы", "длина участка", "всего", "итого"]

# --- fixed values: table headers, tables and rows ----------------------------------------------------------------
HEADER_ALIASES = {
    "work": ["наименование работ и затрат", "наименование работ", "наименование работы", "вид работ", "вид работы", "перечень работ", "описание работ", "работа", "наименование"],
    "unit": ["единица измерения", "ед. изм.", "ед изм", "ед.изм.", "единица изм.", "единица"],
    "quantity": ["количество по проекту", "объем по проекту", "объём по проекту", "объем работ", "объём работ", "количество", "кол-во", "кол во", "объем", "объём"],
    "start_date": ["начало", "начало работ", "дата начала"],
    "finish_date": ["окончание", "окончание работ", "дата окончания"],
}
GENERIC_NAME_HEADER = "наименование"
TABLE_PHRASES = {
    "work": ["ведомость объемов работ", "ведомость объёмов работ", "ведомость работ", "виды и объемы работ", "виды и объёмы работ", "наименование работ", "объем работ", "объём работ"],
    "mixed": ["материалы и работы", "стоимость ед", "стоимость", "ндс", "цены"],
    "material": ["ведомость материалов", "спецификация материалов", "материал", "материалы"],
    "schedule": ["гпр", "график производства работ", "календарный график", "начало работ", "окончание работ", "продолжительность"],
}
MIXED_PHRASE, PRICE_PHRASES = "материалы и работы", ["стоимость", "стоимость ед", "ндс", "цены"]
START_HEADERS, FINISH_HEADERS = ["начало", "начало работ"], ["окончание", "окончание работ"]
CALENDAR_CELL = r"^(?:январь|февраль|март|апрель|май|июнь|июль|август|сентябрь|октябрь|ноябрь|декабрь)$|^\d+\s*нед|^20\d{2}\s*г?$"
ROW_PREFIXES = {
    "summary": ["итого", "всего", "в том числе", "в т ч", "итого по разделу", "всего по разделу", "итого по главе"],
    "section": ["раздел ", "глава ", "подраздел ", "этап ", "комплекс работ"],
    "strong_machinery": ["буровая установка", "установка буровая"],
    "work": ["устройство ", "монтаж ", "демонтаж ", "прокладка ", "укладка ", "установка ", "кладка ", "бетонирование ", "армирование ", "сварка ", "окраска ", "покраска ", "штукатурка ", "оштукатуривание ", "шпатлевание ", "шпаклевание ", "облицовка ", "грунтование ", "разработка грунта", "обратная засыпка", "засыпка ", "уплотнение ", "бурение ", "резка ", "сверление ", "нанесение ", "очистка ", "изоляция ", "гидроизоляция ", "планировка ", "разборка ", "замена ", "ремонт ", "работы по "],
    "material": ["раствор ", "бетон ", "цемент ", "песок ", "щебень ", "кирпич ", "блок ", "арматура ", "сталь ", "труба ", "кабель ", "провод ", "краска ", "грунтовка ", "герметик ", "мастика ", "утеплитель ", "минеральная вата", "минвата ", "стекло ", "лист ", "профиль ", "уголок ", "хомут ", "болт ", "гайка ", "шайба ", "крепеж ", "крепёж ", "панель ", "плита ", "доска ", "брус ", "рубероид ", "мембрана ", "геотекстиль ", "асфальтобетон ", "битум "],
    "machinery": ["кран ", "автокран ", "экскаватор ", "бульдозер ", "погрузчик ", "самосвал ", "автосамосвал ", "манипулятор ", "автовышка ", "подъемник ", "подъёмник ", "компрессор ", "виброплита ", "каток ", "машина ", "механизм ", "буровая установка", "установка буровая"],
}

# --- fixed values: taxonomy --------------------------------------------------------------------------------------
#: Family, required roots, and for each variant (marker kind, text, score).
TAXONOMY = {
    "cable-duct": {
        "required": ["кабельн", "канализац"],
        "variants": {
            "underground": [("root", "подземн", 96), ("root", "транш", 90), ("root", "грунт", 82)],
            "above-ground": [("root", "надземн", 96), ("phrase", "по опорам", 82), ("phrase", "по поверхности", 78)],
            "overpass": [("root", "эстакад", 98)],
            "bridge": [("root", "мост", 98), ("root", "пролетн", 90)],
        },
    }
}

# --- fixed values: history texts ---------------------------------------------------------------------------------
#: Field of a material and its label, in the order in which changes are told.
HISTORY_FIELDS = [
    ("project", "Проект"), ("object", "Объект"), ("work", "Работа"), ("name", "Материал"), ("responsible", "Ответственный"), ("need", "Потребность"),
    ("unit", "Единица"), ("stock", "Общий остаток"), ("reserved", "Резерв"), ("confirmed", "Подтверждено"), ("delivery", "Дата поставки"), ("lead_days", "Срок поставки"),
]
HISTORY_ACTIONS = {"create": "Добавлено", "update": "Изменено", "archive": "Исключено", "restore": "Восстановлено"}
HISTORY_CREATED, HISTORY_UNCHANGED = "Создана позиция: ", "Сохранение без изменения контролируемых полей."
HISTORY_ARCHIVED = "Позиция исключена из активного расчёта. Предыдущие данные сохранены."
HISTORY_RESTORED = "Позиция восстановлена в активный расчёт."

# --- fixed values: documents -------------------------------------------------------------------------------------
#: Kind and its phrases with weights, in order of precedence.
DOCUMENT_KINDS = {
    "schedule": [("график производства работ", 8), ("календарный график", 7), ("календарный план", 6), ("гпр", 5), ("начало работ", 3), ("окончание работ", 3), ("продолжительность", 2), ("срок выполнения", 2)],
    "specification": [("спецификация оборудования", 8), ("спецификация материалов", 8), ("наименование и техническая характеристика", 7), ("единица измерения", 4), ("ед. изм.", 4), ("количество", 3), ("масса единицы", 3), ("позиция", 2)],
    "work-volume": [("ведомость объемов работ", 8), ("ведомость объёмов работ", 8), ("объем работ", 5), ("объём работ", 5), ("вид работ", 3), ("единица измерения", 3), ("количество", 2)],
    "cable-journal": [("кабельный журнал", 10), ("марка кабеля", 6), ("длина кабеля", 5), ("откуда", 3), ("куда", 3), ("обозначение кабеля", 4)],
    "explanatory-note": [("пояснительная записка", 10), ("общие указания", 5), ("исходные данные", 4), ("принятые решения", 4), ("технические решения", 3)],
    "commercial-proposal": [("коммерческое предложение", 10), ("технико-коммерческое предложение", 10), ("ценовое предложение", 8), ("коммерческая часть", 6), ("стоимость предложения", 6), ("итого к оплате", 4)],
    "agreement": [("дополнительное соглашение", 10), ("приложение к договору", 8), ("договорная ведомость", 8), ("предмет договора", 5), ("стоимость договора", 5)],
    "estimate": [("локальная смета", 9), ("локальный сметный расчет", 9), ("локальный сметный расчёт", 9), ("сметная стоимость", 6), ("ресурсная ведомость", 6), ("шифр расценки", 5), ("всего по смете", 5)],
    "working-documents": [("рабочая документация", 7), ("рабочий проект", 5), ("общие данные", 4), ("стадия", 2), ("номер листа", 3), ("формат", 2), ("лист", 1)],
}
COVER_PATTERN = r"(?:проектн[а-яё]*|рабоч[а-яё]*)\s+документац[а-яё]*|рабоч[а-яё]*\s+проект[а-яё]*|пояснительн[а-яё]*\s+записк[а-яё]*"
#: Kind of the intake register for a kind found in text.
INTAKE_KIND = {"working-documents": "project-documentation", "explanatory-note": "project-documentation", "work-volume": "work-volume", "schedule": "schedule", "specification": "specification", "estimate": "estimate", "commercial-proposal": "commercial-proposal", "agreement": "agreement", "cable-journal": "other"}
REGISTRY_KIND = {"working-documents": "project-documentation", "work-volume": "work-volume", "schedule": "schedule", "specification": "specification", "estimate": "estimate", "commercial-proposal": "commercial-proposal", "agreement": "agreement", "cable-journal": "journal"}
#: Patterns of lower-case file names and the kind of upload that they tell, the first that is found.
FILE_NAME_KINDS = [
    ("вор|ведомост", "work-volume"),
    ("гпр|график", "schedule"),
    ("доп.*соглаш|соглаш.*доп", "agreement"),
    ("коммерч|ткп|(^|[^а-яa-z0-9])кп([^а-яa-z0-9]|$)", "commercial-proposal"),
    ("смет", "estimate"),
    (r"\.pdf$", "project-documentation"),
]
#: Kind, strength, pattern: signals of the intake classifier.
_T = "[а-яё]*"
SIGNALS = {
    "commercial-proposal": {
        "strong": [rf"коммерческ{_T}\s+предложени{_T}", rf"технико-коммерческ{_T}\s+предложени{_T}", rf"ценов{_T}\s+предложени{_T}", r"(^|[^а-яa-z0-9])ткп([^а-яa-z0-9]|$)", r"(^|[^а-яa-z0-9])кп([^а-яa-z0-9]|$)"],
        "weak": [rf"стоимост{_T}\s+предложени{_T}", rf"коммерческ{_T}\s+част{_T}"],
    },
    "agreement": {
        "strong": [rf"договор{_T}(?:\s+подряд{_T})?\s*№", rf"дополнительн{_T}\s+соглашени{_T}", rf"доп\.?\s*соглашени{_T}", r"(^|[^а-яa-z0-9])дс\s*№?", rf"приложени{_T}\s+к\s+договор{_T}", rf"договорн{_T}\s+ведомост{_T}"],
        "weak": [rf"стоимост{_T}\s+договор{_T}", rf"предмет\s+договор{_T}"],
    },
    "estimate": {
        "strong": [rf"локальн{_T}\s+смет{_T}", rf"сметн{_T}\s+документац{_T}", rf"сметн{_T}\s+расч[её]т{_T}", r"(^|[^а-яa-z0-9])смета([^а-яa-z0-9]|$)"],
        "weak": [rf"сметн{_T}\s+стоимост{_T}", rf"шифр\s+расценк{_T}"],
    },
    "schedule": {
        "strong": [rf"график\s+производств{_T}\s+работ{_T}", rf"календарн{_T}\s+график{_T}", rf"календарн{_T}\s+план{_T}", r"(^|[^а-яa-z0-9])гпр([^а-яa-z0-9]|$)"],
        "weak": [rf"начал{_T}\s+работ{_T}", rf"окончани{_T}\s+работ{_T}", rf"продолжительност{_T}", rf"срок{_T}\s+выполнени{_T}"],
    },
    "work-volume": {
        "strong": [rf"ведомост{_T}\s+объем{_T}\s+работ{_T}", rf"ведомост{_T}\s+объ[её]м{_T}\s+работ{_T}", r"(^|[^а-яa-z0-9])вор([^а-яa-z0-9]|$)"],
        "weak": [rf"объем{_T}\s+работ{_T}", rf"объ[её]м{_T}\s+работ{_T}", rf"вид{_T}\s+работ{_T}"],
    },
    "specification": {
        "strong": [rf"спецификац{_T}\s+материал{_T}", rf"спецификац{_T}\s+оборудован{_T}", rf"(^|[^а-яa-z0-9])спецификац{_T}"],
        "weak": [rf"наименовани{_T}\s+и\s+техническ{_T}\s+характеристик{_T}"],
    },
    "project-documentation": {
        "strong": [rf"рабоч{_T}\s+документац{_T}", rf"проектн{_T}\s+документац{_T}", rf"пояснительн{_T}\s+записк{_T}", rf"рабоч{_T}\s+проект{_T}"],
        "weak": [rf"общие\s+указани{_T}", r"общие\s+данные"],
    },
}

# --- fixed values: material rows in page text --------------------------------------------------------------------
MATERIAL_PAGE_STRONG = [rf"спецификац{_T}(?:\s+[а-яё]+){{0,5}}\s+(?:оборудован|материал|издел)", rf"наименовани{_T}\s+и\s+техническ{_T}\s+характеристик", rf"наименовани{_T}\s+вида?\s+работ{_T}\s+и\s+материал"]
MATERIAL_PAGE_MARKERS = [r"(^|\s)поз\.?($|\s)", r"ед\.?\s*изм\.*", r"(^|\s)кол(?:\.|ичество)($|\s)", "поставщик", rf"примечани{_T}", r"масса\s+(?:единиц|1\s*ед)"]
MATERIAL_ROW = r"(?iu)^[ \t]*(?:\d+(?:\.\d+)*[ \t]+)?([А-ЯA-ZЁ][А-Яа-яA-Za-zЁё0-9«»\"'№%()/.,:+\-–—×xХ \t]{2,160}?)[ \t]+(шт\.?|штук|п\.?[ \t]*м\.?|м²|м2|м³|м3|м|кг|т|л|компл\.?|комплект|упак\.?|упаковка|рул\.?|рулон)[ \t]+(\d+(?:[.,]\d+)?)(?=[ \t]|$|[.,;:)])"
MATERIAL_NOISE = [r"(^|\s)(?:площадью|площадь|длиной|длина|высотой|высота|отм\.?|отметка)(?:\s|$)", r"для\s+\d+\s+секци", r"h\s*\(\s*max\s*\)", r"общие\s+технические\s+условия", r"(^|\s)(?:гост|сп|снип|ту)\s*\d", r"(?:поз\.?|позиция)\s+наименовани", rf"наименовани{_T}\s+ед\.?\s*изм", r"(?:ед\.?\s*изм|количество|примечание|страница|лист)\s*$", r"(?:разработал|проверил|согласовано|инв\.?\s*№|подп\.?\s*и\s*дата)"]
MATERIAL_WORK_VERBS = [r"^(?:монтаж|демонтаж|прокладка|установка|разработка|обратная\s+засыпка|восстановление|разборка|пусконаладоч|пнр)(?:\s|$)", rf"^устройство\s+(?:фундамент|кабельн{_T}\s+канализац|дорожн|покрыт|колодц|опор|светофорн{_T}\s+объект)"]
MATERIAL_STEMS = "кабел провод труб шкаф коммутатор светофор контроллер детектор видеокамер камер опор фундамент бетон песок грунт щебен колод муфт клемм автомат выключател разъем короб модул блок креплен стойк лоток панел трансформатор счетчик датчик радиолокатор приемник передатчик сервер маршрутизатор усилител аккумулятор розетк термостат нагревател вентилятор кондиционер капсул шпильк анкер болт гайк шайб заземл электрод светильник ламп цемент раствор кирпич сетк арматур сталь гипс утеплител изоляц краск грунтовк двер окн профил кронштейн цоколь".split()
MODEL_CODE = r"[A-ZА-ЯЁ]{2,}[A-ZА-ЯЁ0-9./+\-]*\d|[A-ZА-ЯЁ]{3,}"

# --- fixed values: approvals -------------------------------------------------------------------------------------
APPROVAL_ACTION = rf"(?iu)(согласован{_T}|согласовать|согласование|разрешени{_T}|техническ{_T}\s+услови{_T}|технадзор|техническ{_T}\s+надзор|допуск(?:а|у|ом|е|и)?(?=[^а-яё]|$)|ордер(?:а|у|ом|е|ы|ов)?(?=[^а-яё]|$)|вызов{_T}\s+представител{_T}|уведомить|уведомлени{_T})"
STAMP_MARKERS = [r"(^|\s)изм\.?($|\s)", r"кол\.?\s*уч\.?", r"№\s*док", r"(^|\s)лист($|\s)", r"(^|\s)подп\.?($|\s)", r"(^|\s)дата($|\s)", r"разраб\.?", "проверил", r"н\.?\s*контр\.?", r"инв\.?\s*№"]
STAMP_REAL_ACTION = r"до\s+начала|перед\s+началом|до\s+производства\s+работ|получить\s+(?:согласован|разрешен|допуск)|согласовать\s+с|необходимо\s+согласовать|следует\s+согласовать|требуется\s+согласовать|по\s+согласованию\s+с|вызвать\s+представител|уведомить"
APPROVAL_TYPES = [
    (rf"техническ{_T}\s+услови{_T}|(^|[^а-я])ту([^а-я]|$)", "technical-conditions"),
    (rf"технадзор|техническ{_T}\s+надзор|вызов{_T}\s+представител{_T}", "supervision"),
    (rf"разрешени{_T}|допуск(?:а|у|ом|е|и)?(?=[^а-яё]|$)|ордер(?:а|у|ом|е|ы|ов)?(?=[^а-яё]|$)", "permit"),
    (rf"уведомить|уведомлени{_T}", "notification"),
]
ORGANIZATIONS = [
    (r"(^|[^а-яa-z])ржд([^а-яa-z]|$)", "РЖД"), ("гормост", "Гормост"), ("гормос", "Гормост / организация требует уточнения"), ("моссвет", "Моссвет"), ("мосводоканал", "Мосводоканал"), (rf"заказчик{_T}", "Заказчик"),
    (rf"проектн{_T}\s+организац{_T}|проектн{_T}\s+отдел{_T}|проектировщик{_T}", "Проектная организация"), (rf"балансодержател{_T}", "Балансодержатель"), (rf"эксплуатирующ{_T}\s+организац{_T}", "Эксплуатирующая организация"),
    (rf"владел{_T}\s+сет{_T}|владел{_T}\s+коммуникац{_T}", "Владелец инженерных сетей"),
]
ORGANIZATION_UNKNOWN = "Организация требует уточнения"
APPROVAL_INTENTS = [
    (r"до\s+начала|перед\s+началом|до\s+производства\s+работ|до\s+выполнения\s+работ|до\s+начала\s+строительств|получить\s+(?:согласован|разрешен|допуск|техническ)", "prerequisite", "high"),
    (r"при\s+замене|в\s+случае|по\s+согласованию|при\s+согласовании", "conditional", "medium"),
    (rf"согласовать|необходимо\s+согласован|следует\s+согласован|требуется\s+согласован|разрешени{_T}|допуск(?:а|у|ом|е|и)?(?=[^а-яё]|$)|ордер(?:а|у|ом|е|ы|ов)?(?=[^а-яё]|$)|вызов{_T}\s+представител{_T}|уведомить", "action", "medium"),
]
