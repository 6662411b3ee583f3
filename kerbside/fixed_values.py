"""Vocabularies, phrase lists, patterns and weights the results depend on.

Everything here is plain data. Operators take these as default arguments, so another
market or language is a parameter and not a code change.
"""

# ---------------------------------------------------------------- canonical vocabularies
# Raw spelling (lower case) -> canonical value.
TRANSMISSION = {
    "автомат": "АКПП",
    "автоматическая": "АКПП",
    "акпп": "АКПП",
    "механика": "МКПП",
    "механическая": "МКПП",
    "мкпп": "МКПП",
    "вариатор": "вариатор",
    "робот": "робот",
    "роботизированная": "робот",
    "amt": "робот",
    "automatic": "АКПП",
    "mechanical": "МКПП",
    "robot": "робот",
    "variator": "вариатор",
    "auto": "АКПП",
    "at": "АКПП",
    "mt": "МКПП",
    "cvt": "вариатор",
}
DRIVE = {
    "передний": "передний",
    "задний": "задний",
    "полный": "полный",
    "front_drive": "передний",
    "rear_drive": "задний",
    "all_wheel_drive": "полный",
    "forward_control": "передний",
    "4wd": "полный",
    "awd": "полный",
    "fwd": "передний",
    "rwd": "задний",
}
BODY = {
    "седан": "седан",
    "хэтчбек": "хэтчбек",
    "хетчбек": "хэтчбек",
    "лифтбек": "лифтбек",
    "универсал": "универсал",
    "кроссовер": "кроссовер",
    "внедорожник": "внедорожник",
    "купе": "купе",
    "кабриолет": "кабриолет",
    "минивэн": "минивэн",
    "фургон": "фургон",
    "пикап": "пикап",
    "микроавтобус": "фургон",
    "компактвэн": "минивэн",
    "sedan": "седан",
    "hatchback": "хэтчбек",
    "hatchback_3_doors": "хэтчбек",
    "hatchback_5_doors": "хэтчбек",
    "liftback": "лифтбек",
    "wagon": "универсал",
    "allroad": "кроссовер",
    "allroad_3_doors": "внедорожник",
    "allroad_5_doors": "кроссовер",
    "coupe": "купе",
    "cabrio": "кабриолет",
    "minivan": "минивэн",
    "van": "фургон",
    "pickup": "пикап",
}
ENGINE = {
    "бензин": "бензин",
    "бензиновый": "бензин",
    "дизель": "дизель",
    "дизельный": "дизель",
    "гибрид": "гибрид",
    "электро": "электро",
    "электрический": "электро",
    "газ": "газ",
    "газовый": "газ",
    "gasoline": "бензин",
    "diesel": "дизель",
    "hybrid": "гибрид",
    "electro": "электро",
    "lpg": "газ",
    "turbo": "бензин",
}
STEERING = {
    "левый": "левый",
    "правый": "правый",
    "left": "левый",
    "right": "правый",
    "lhd": "левый",
    "rhd": "правый",
    "left_hand_drive": "левый",
    "right_hand_drive": "правый",
}
TITLE_DOCUMENT = {
    "оригинал": "оригинал",
    "дубликат": "дубликат",
    "электронный": "электронный",
    "original": "оригинал",
    "duplicate": "дубликат",
    "electronic": "электронный",
}
SELLER_TYPE = {
    "частное лицо": "частное лицо",
    "дилер": "дилер",
    "автосалон": "автосалон",
    "private": "частное лицо",
    "commercial": "дилер",
    "dealer": "дилер",
}
COLOR = {
    "black": "чёрный",
    "white": "белый",
    "silver": "серебристый",
    "grey": "серый",
    "red": "красный",
    "blue": "синий",
    "light_blue": "голубой",
    "green": "зелёный",
    "brown": "коричневый",
    "gold": "золотистый",
    "orange": "оранжевый",
    "yellow": "жёлтый",
    "purple": "фиолетовый",
    "violet": "фиолетовый",
    "pink": "розовый",
    "beige": "бежевый",
    "чёрный": "чёрный",
    "белый": "белый",
    "серебристый": "серебристый",
    "серый": "серый",
    "красный": "красный",
    "синий": "синий",
    "голубой": "голубой",
    "зелёный": "зелёный",
    "коричневый": "коричневый",
    "золотистый": "золотистый",
    "оранжевый": "оранжевый",
    "жёлтый": "жёлтый",
    "фиолетовый": "фиолетовый",
    "розовый": "розовый",
    "бежевый": "бежевый",
}
CATEGORICAL_FIELDS = {
    "transmission": TRANSMISSION,
    "drive_type": DRIVE,
    "body_type": BODY,
    "engine_type": ENGINE,
    "steering_wheel": STEERING,
    "pts_type": TITLE_DOCUMENT,
    "seller_type": SELLER_TYPE,
    "color": COLOR,
}

# Brand spellings (lower case) -> brand.
BRAND = {
    "ваз": "LADA",
    "вaz": "LADA",
    "лада": "LADA",
    "vaz": "LADA",
    "lada": "LADA",
    "vaz_lada": "LADA",
    "vaz (lada)": "LADA",
    "lada (ваз)": "LADA",
    "lada (вaz)": "LADA",
    "лада (ваз)": "LADA",
    "ваз (lada)": "LADA",
    "lada(ваз)": "LADA",
    "уаз": "UAZ",
    "uaz": "UAZ",
    "газ": "GAZ",
    "gaz": "GAZ",
    "заз": "ZAZ",
    "zaz": "ZAZ",
    "москвич": "Moskvitch",
    "хёндэ": "Hyundai",
    "хендай": "Hyundai",
    "хендэ": "Hyundai",
    "хундай": "Hyundai",
    "киа": "Kia",
    "кия": "Kia",
    "тойота": "Toyota",
    "ниссан": "Nissan",
    "мазда": "Mazda",
    "митсубиси": "Mitsubishi",
    "мицубиси": "Mitsubishi",
    "субару": "Subaru",
    "сузуки": "Suzuki",
    "хонда": "Honda",
    "лексус": "Lexus",
    "инфинити": "Infiniti",
    "акура": "Acura",
    "мерседес": "Mercedes-Benz",
    "мерседес-бенц": "Mercedes-Benz",
    "mercedes": "Mercedes-Benz",
    "mercedes-benz": "Mercedes-Benz",
    "бмв": "BMW",
    "bmw": "BMW",
    "фольксваген": "Volkswagen",
    "шкода": "Skoda",
    "skoda": "Skoda",
    "ауди": "Audi",
    "audi": "Audi",
    "опель": "Opel",
    "порше": "Porsche",
    "porsche": "Porsche",
    "дэу": "Daewoo",
    "равон": "Ravon",
    "рено": "Renault",
    "пежо": "Peugeot",
    "ситроен": "Citroen",
    "форд": "Ford",
    "шевроле": "Chevrolet",
    "джип": "Jeep",
    "додж": "Dodge",
    "крайслер": "Chrysler",
    "кадиллак": "Cadillac",
    "линкольн": "Lincoln",
    "лэнд ровер": "Land Rover",
    "ленд ровер": "Land Rover",
    "ягуар": "Jaguar",
    "бентли": "Bentley",
    "роллс-ройс": "Rolls-Royce",
    "мини": "MINI",
    "вольво": "Volvo",
    "феррари": "Ferrari",
    "ламборгини": "Lamborghini",
    "чери": "Chery",
    "черри": "Chery",
    "хавал": "Haval",
    "хавейл": "Haval",
    "джили": "Geely",
    "чанган": "Changan",
    "грейт волл": "Great Wall",
    "лифан": "Lifan",
}

# City slug in a page address -> city name, and -> federal region.
CITY_BY_SLUG = {
    "moscow": "Москва",
    "spb": "Санкт-Петербург",
    "krasnodar": "Краснодар",
    "samara": "Самара",
    "ekaterinburg": "Екатеринбург",
    "novosibirsk": "Новосибирск",
    "kazan": "Казань",
    "rostov": "Ростов-на-Дону",
    "nn": "Нижний Новгород",
    "nnovgorod": "Нижний Новгород",
    "nizhniynovgorod": "Нижний Новгород",
    "chelyabinsk": "Челябинск",
    "voronezh": "Воронеж",
    "volgograd": "Волгоград",
    "ufa": "Уфа",
    "perm": "Пермь",
    "krasnoyarsk": "Красноярск",
    "omsk": "Омск",
    "vladivostok": "Владивосток",
    "habarovsk": "Хабаровск",
    "irkutsk": "Иркутск",
    "tula": "Тула",
    "barnaul": "Барнаул",
    "tyumen": "Тюмень",
    "saratov": "Саратов",
    "tolyatti": "Тольятти",
    "izhevsk": "Ижевск",
}
REGION_BY_SLUG = {
    "moscow": "Москва",
    "spb": "Санкт-Петербург",
    "krasnodar": "Краснодарский край",
    "samara": "Самарская область",
    "ekaterinburg": "Свердловская область",
    "novosibirsk": "Новосибирская область",
    "kazan": "Республика Татарстан",
    "rostov": "Ростовская область",
    "nn": "Нижегородская область",
    "nnovgorod": "Нижегородская область",
    "nizhniynovgorod": "Нижегородская область",
    "chelyabinsk": "Челябинская область",
    "voronezh": "Воронежская область",
    "volgograd": "Волгоградская область",
    "ufa": "Республика Башкортостан",
    "perm": "Пермский край",
    "krasnoyarsk": "Красноярский край",
    "omsk": "Омская область",
    "vladivostok": "Приморский край",
    "habarovsk": "Хабаровский край",
    "irkutsk": "Иркутская область",
    "tula": "Тульская область",
    "barnaul": "Алтайский край",
    "tyumen": "Тюменская область",
    "saratov": "Саратовская область",
    "tolyatti": "Самарская область",
    "izhevsk": "Удмуртская Республика",
}

# Paint code -> colour name.
COLOR_BY_HEX = {
    "040001": "black",
    "fafbfb": "white",
    "c49648": "gold",
    "cacecb": "silver",
    "97948f": "grey",
    "ee1d19": "red",
    "0000cc": "blue",
    "22a0f8": "light_blue",
    "007f00": "green",
    "200204": "brown",
    "660099": "purple",
    "dea522": "orange",
    "ffd600": "yellow",
    "ff69b4": "pink",
    "4a2197": "violet",
}

# Attribute title on a detail page -> field.
ATTRIBUTE_FIELD = {
    "Пробег": "mileage_raw",
    "Коробка передач": "transmission",
    "Привод": "drive_type",
    "Кузов": "body_type",
    "Тип кузова": "body_type",
    "Цвет кузова": "color",
    "Цвет": "color",
    "Двигатель": "engine_raw",
    "Тип двигателя": "engine_type",
    "Объём двигателя": "engine_volume_raw",
    "Мощность двигателя": "power_raw",
    "Мощность": "power_raw",
    "VIN или номер кузова": "vin",
    "VIN": "vin",
    "Владельцы": "owners_raw",
    "Владельцев по ПТС": "owners_raw",
    "Количество по ПТС": "owners_raw",
    "Количество владельцев": "owners_raw",
    "Руль": "steering",
    "Состояние": "condition",
    "ПТС": "pts_type",
    "Тип ПТС": "pts_type",
    "Растаможен": "customs_raw",
    "Таможня": "customs_raw",
    "Поколение": "generation",
    "Модификация": "modification",
    "Комплектация": "modification",
    "Повреждения": "damage_raw",
    "ДТП": "accidents_raw",
    "Участие в ДТП": "accidents_raw",
    "Гарантия": "warranty_raw",
    "Обмен": "exchange_raw",
}

# Transmission code in an ad title -> name written by the title enrichment.
TITLE_TRANSMISSION = {"AT": "АКПП", "MT": "МКПП", "CVT": "Вариатор", "AMT": "Робот"}

# Yes / no words, dealer words, fuels.
YES_WORDS = ["да", "растаможен", "растаможена", "оформлен", "оформлена"]
NO_WORDS = ["нет", "не растаможен", "не растаможена", "не оформлен", "не оформлена"]
DEALER_WORDS = ["дилер", "салон", "dealer", "salon"]
FUELS = ["бензин", "дизель", "гибрид", "электро", "газ"]
SELLER_PRIVATE_WORDS = ["private", "частное лицо", "owner"]
SELLER_DEALER_WORDS = ["shop", "company", "dealer", "дилер", "компания"]
PAGE_DEALER_WORDS = ["автодилер", "автосалон", "официальный дилер"]
PHOTO_SKIP_WORDS = ["avatar", "logo", "icon", "favicon", "32x32", "48x48", "64x64"]
PROMOTED_TITLE = "Продвинуто"

# ---------------------------------------------------------------- categories
# Listing categories, labels, base scores and aliases (alias order matters).
CATEGORIES = ["clean", "damaged_body", "bad_docs", "debtor", "complex_but_profitable"]
PROBLEM_CATEGORIES = ["damaged_body", "bad_docs", "debtor"]
CATEGORY_LABELS = {
    "clean": "Чистая",
    "damaged_body": "Битая",
    "bad_docs": "Плохие документы",
    "debtor": "Должник",
    "complex_but_profitable": "Сложная, но выгодная",
}
ALERT_CATEGORY_LABELS = {
    "clean": "Чистая",
    "damaged_body": "Битый кузов",
    "bad_docs": "Проблемы с ПТС",
    "debtor": "Залог/долги",
    "complex_but_profitable": "Сложная, но выгодная",
}
CATEGORY_BASE_SCORE = {
    "clean": 1.0,
    "complex_but_profitable": 0.7,
    "damaged_body": 0.3,
    "bad_docs": 0.2,
    "debtor": 0.15,
}
CATEGORY_ALIASES = {
    "clean": "clean",
    "damaged_body": "damaged_body",
    "bad_docs": "bad_docs",
    "debtor": "debtor",
    "complex_but_profitable": "complex_but_profitable",
    "document_issues": "bad_docs",
    "owner_debtor": "debtor",
    "complex_profitable": "complex_but_profitable",
    "junk": "damaged_body",
    "bad_documents": "bad_docs",
    "docs_issues": "bad_docs",
    "doc_issues": "bad_docs",
    "debt": "debtor",
    "complex": "complex_but_profitable",
    "profitable": "complex_but_profitable",
}

# ---------------------------------------------------------------- text
# Phrases that cap the deal score, negatable damage words, phrases that bar
# a listing from training, and the flags a classifier is asked to report.
DEAL_RED_FLAGS = [
    "на запчасти",
    "под разбор",
    "не на ходу",
    "в залоге",
    "запрет",
    "не заводится",
    "утеряны документы",
    "без птс",
    "конструктор",
    "после дтп",
    "требует ремонт",
    "требует вложен",
    "bityy",
]
DAMAGE_WORDS = ["битый", "битая", "бит."]
NEGATIONS = ["не ", "не-"]
TRAINING_RED_FLAGS = [
    "на запчасти",
    "под разбор",
    "не на ходу",
    "в залоге",
    "не заводится",
    "утеряны документы",
    "без птс",
    "конструктор",
]
CONDITION_FLAGS = {
    "звонить понимающим": r"звонить\s+понимающим",
    "не на ходу": r"не\s+на\s+ходу",
    "требует вложений": r"требует\s+вложени",
    "срочно": r"срочно",
    "торг": r"торг",
    "без ПТС": r"без\s+птс",
    "на запчасти": r"(?:по|на)\s+запчаст",
    "после ДТП": r"после\s+дтп",
    "залог / кредит": r"залог|кредит",
    "запрет на рег. действия": r"запрет\s+на\s+рег",
    "один хозяин": r"1\s+собственник|один\s+хозяин",
    "гаражное хранение": r"гаражное\s+хранение",
    "не бита не крашена": r"не\s+бита\s+не\s+крашена",
}
# Keyword features (regular expressions, case-insensitive).
KEYWORD_PATTERNS = {
    "kw_not_damaged": r"не\s*бит|без\s*дтп|без\s*аварий|не\s*краш",
    "kw_one_owner": r"один\s*(?:хозяин|владел)|1\s*(?:хозяин|владел)|первый\s*владел",
    "kw_original_mileage": r"оригинальн\w*\s*пробег|подтвержд\w*\s*пробег|реальн\w*\s*пробег",
    "kw_garage_kept": r"гаражн\w*\s*хранен|в\s*гараже",
    "kw_good_condition": r"идеальн\w*\s*состоян|отличн\w*\s*состоян|хорош\w*\s*состоян",
    "kw_original_paint": r"родн\w*\s*(?:краск|окрас|цвет)|оригинальн\w*\s*(?:краск|окрас)",
    "kw_original_pts": r"оригинал\w*\s*птс|птс\s*оригинал",
    "kw_serviced": r"обслужен|прошл?\w*\s*то|замен\w*\s*масл|регулярн\w*\s*то",
    "kw_warranty": r"гарантия|на\s*гарантии|дилерск\w*\s*гарант",
    "kw_full_package": r"максимальн\w*\s*комплект|полн\w*\s*комплект|топов\w*\s*комплект",
    "kw_damaged": r"(?<!не\s)бит\w{0,3}(?:\s|$|,)|после\s*дтп|аварийн\w*|удар\w*\s*в\s",
    "kw_duplicate_pts": r"дубликат\w*\s*птс|птс\s*дубликат",
    "kw_many_owners": r"(?:[3-9]|1[0-9])\s*(?:хозяин|владел)|много\s*владел",
    "kw_needs_repair": r"требует\s*(?:ремонт|вложен)|нужен\s*ремонт|разобран",
    "kw_rust": r"(?:ржав|коррози|гнил)\w*|сквозн\w*\s*(?:дыр|ржав)",
    "kw_high_mileage": r"большой\s*пробег|высок\w*\s*пробег",
    "kw_dealer": r"автосалон|автодилер|кредит\w*\s*(?:ставк|платеж|взнос)|trade.?in|трейд.?ин",
    "kw_credit": r"кредит|рассрочк|ежемесячн\w*\s*платеж",
    "kw_urgent": r"срочно|торг\w*(?:$|\s|!)|быстр\w*\s*продаж",
    "kw_leather": r"кож\w*\s*(?:салон|сиден)|натуральн\w*\s*кож",
    "kw_climate": r"климат.?контрол|двухзонн\w*\s*климат",
    "kw_heated_seats": r"подогрев\w*\s*сиден|обогрев\w*\s*сиден",
    "kw_camera": r"камер\w*\s*(?:задн|парков)|парктроник",
}
# Stop words of the description tokeniser.
STOP_WORDS = [
    "и", "в", "на", "с", "по", "для", "от", "до", "не", "из", "за", "к",
    "о", "у", "как", "все", "что", "это", "так", "или", "но", "а", "при", "уже",
    "если", "вы", "мы", "он", "она", "вас", "вам", "нас", "нам", "его", "её", "был",
    "была", "были", "быть", "есть", "будет", "также", "только", "можно", "нужно", "очень", "более", "менее",
    "автомобиль", "авто", "машина", "продаж", "продажа",
]

# ---------------------------------------------------------------- price model
# Premium makes, smoothing strengths, blend weights, neighbour weights.
PREMIUM_BRANDS = [
    "bmw",
    "mercedes-benz",
    "mercedes",
    "audi",
    "lexus",
    "porsche",
    "infiniti",
    "jaguar",
    "land rover",
    "volvo",
    "cadillac",
    "maserati",
    "bentley",
    "rolls-royce",
    "ferrari",
    "lamborghini",
    "tesla",
]
ENCODING_SMOOTHING = {"brand_model_year": 10, "brand_model": 30, "brand": 50, "city": 50}
STACK_WEIGHTS = (0.40, 0.40, 0.20)
NEIGHBOUR_WEIGHTS = {"year": 0.35, "mileage": 0.45, "engine": 0.20}
CURRENT_YEAR = 2026
