"""Labelled texts for the trees of ``privacy``: sentences put together at random from frames of our own and invented values."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

# Frames with a place {} for one piece of personal information, by kind; ¶ is a new line.
FRAMES = {
    "email": """Please answer at {}.|You can reach the office under {} at any hour.|{} is where the receipts should go.|Registered as {} since March|Her address for post online: {}|write back: {}|Forwarded by {} yesterday
Subscribe with {}; the code arrives at once.|The form wanted a mail address, I gave {}.|Questions? {}|Sent from {}|Bitte alles an {} schicken.|Mein Postfach heißt {}.|Rückfragen gern unter {}|Escríbenos a {} cuando puedas.|El buzón nuevo es {}.
Envoyez le dossier à {}.|Pour répondre : {}|請回覆到{}。|電子郵件：{}|他的帳號是{}，不要外傳。|把照片傳到{}吧|{}|- {}|Helpdesk ({})|<{}>|Half the list bounced, even {}!|user {} logged in|photos to {} and copies to the printer""",
    "phone": """Ring me under {} after lunch.|Mobile {}|phone: {}|You can text {} any time.|The plumber answers on {}.|{} was busy all day.|In an emergency dial {}!|I saved {} as the taxi.|Call back {} please|Leave a message at {}.|My digits changed: {}
Hotline ({}) closes at six.|Telefon {}|Du erreichst mich unter {}.|Handy: {}|Mi móvil es {}.|Llama al {} antes de comer.|Appelle-moi au {} ce soir.|Portable : {}|我的手機是{}。|聯絡電話{}|有事請打{}找我|電話號碼換成{}了。|{}|T {}|fax {}|missed {} twice|Reception {} / nights only
whoever has {} keeps hanging up""",
    "id": """The passport is {}.|ID no. {}|My identity card reads {}.|Social security {}|tax reference {} on the letter|Insurance card: {}|They asked for my ID and I typed {}.|Document number {} expires in June.|The licence shows {}.|national insurance number {}
visa form, field 3: {}|copy of {} attached|Ausweis: {}|Die Steuernummer lautet {}.|Versicherungsnummer {}|Mi DNI es {}.|pasaporte {}|NIE {} caducado|Numéro de sécurité sociale : {}|La carte d'identité {} est périmée.|身分證字號{}|護照號碼是{}。|健保卡{}忘在家裡|證件號碼：{}|居留證{}到期了。
the officer read out {} slowly|{}|entered {} at the counter|booked under document {}""",
    "address": """Our house is {}.|Ship it to {} please.|Pick me up at {} at nine.|The new office: {}|Since spring we have been living at {}.|{} is easy to find.|Address: {}|The party is at {}, second bell.|She rents a room in {}.|Return to sender, {}|Parked outside {} again.
Gather in front of {} at noon|Wir treffen uns {}.|Anschrift: {}|Sie wohnt jetzt {}.|Dirección: {}|Vivimos en {} con mi abuela.|La tienda está en {}.|Adresse : {}|On habite {} depuis un an.|Livraison au {} demain.|我家在{}。|地址：{}|送貨到{}就好|公司搬去{}了。|她租在{}附近|{}|the keys are with the shop at {}
{} burned down|mail still goes to {}""",
    "name": """Lunch with {} on Tuesday.|{} called about the keys.|I gave {} the umbrella.|The letter is for {}.|My colleague {} will take over.|Have you heard from {} lately?|{} and I walked home.|We hired {} last month.|{} is my dentist.|Yesterday I ran into {} near the station.|Photo by {}|Dear {},
Hi {}!|Regards,¶{}|Cheers¶{}|{}'s birthday is on Sunday.|Please ask {} for the report.|According to {}, it was closed.|{} told me a joke.|Dinner at the place of {}|so {} left early|the nurse, {}, was kind|Speaker: {}|{} will bring cake.|I miss {}.|Ich habe {} im Zug gesehen.|Heute kommt {} zu Besuch.|{} hat angerufen.
Ein Brief für {}|Cené con {} anoche.|{} me prestó su bici.|Hablé con {} por la mañana.|Merci à {} pour l'aide.|{} habite au premier.|J'ai croisé {} au marché.|跟{}去看展覽|{}今天沒來。|收到{}的信|owner: {}|slept badly, dreamt of {}|{}, who lives upstairs, sings.|{} fell asleep.|Nobody believes {}.
then {} paid for everyone|{} paints, and so does {}.|{} from the third floor knocked|We owe {} an answer.|it was {} who fixed it|a present from {}|The dog bit {}!|{}¶Sales|Sincerely,¶{}""",
    "cjk": """昨晚和{}聊天。|{}明天要搬家。|我跟{}一起上課|{}住在台北|{}很高興。|拜託{}幫忙|老師是{}。|同事{}請假了。|去找{}拿鑰匙|謝謝{}！|{}打電話來|聽{}唱歌|今天{}請我喝茶。|我想念{}。|給{}寫信|{}和我走回家|鄰居{}養了一隻狗。|剛才遇到{}。|{}的生日快到了|大家都喜歡{}|把書還給{}了|{}|{}教我游泳。
媽媽見過{}。|陪{}看醫生|因為{}遲到|寄件人：{}|{}先生請坐|{}小姐來過|請{}老師簽名|昨天{}沒上班|晚上與{}散步|聽說{}生病了。|問過{}才知道|{}不太說話|坐{}的車回去|原來是{}做的|被{}罵了|{}，我的室友，會彈琴。|那天{}在旁邊笑""",
}
# Frames without any, [x] being something harmless.
HARMLESS = """The [org] opens at ten.|We took the train to [town].|Rain over [place] all week.|[place] was crowded.|Bought bread at [org].|A map of [place] hangs there.|The road from [town] to [town] is closed.|Near [place] we stopped.|[town] in autumn is quiet.|Members of the [org] voted.
Saw a film about [town].|On [weekday] the [org] plays.|Version [version] fixes it.|Ticket [ticket] is open.|Invoice no. [invoice], paid [date]|Order [order] ships [date]|ISBN [isbn]|Parcel [track] delayed|Total: [money]|It came to $[money].|Temperature [n].[n] at [time]|[n] people, [n] chairs, [n] tables
Chapter [n], page [n][n]|ping [ip] failed|commit [sha] merged|x = [n] + [n]|def f(x): return x|see https://[lword].example/[sha]?id=[n][n][n][n]|run job #[n][n] at [time]|install [lword]@v[n]|[lword]@latest is out|ssh deploy@[lword]|mention @[lword] or @[lword]|pin [lword]-kit@[version]|[lword]@[sha] builds|needs [lword]@[n].[n]|@everyone look at [lword]/pkg@[version]|Flight [flight] lands [time].|Room [n][n]|Bus [n] and tram [n]|population [n],[n]0,000
Coordinates [n].[n][n], [n].[n][n]|born in [year], moved in [year]|from [year]-[year]|[date] [time] INFO started|Nobody knew.|Everything was fine.|Later that day it snowed.|Some days feel long.|Old habits return.|Good Morning!|Happy New Year|Project [word] starts on [weekday].|The [word] [word] is my favourite book.
Read '[word] of the [word]' twice.|Learning Spanish and German|[weekday] Morning Notes|Der Hund schläft im Garten.|Die Reise nach [town] war lang.|Am [weekday] fahre ich nach [town].|Das Wetter in [town] ist gut.|Ein neues Buch über [place]|Fuimos a [town] en tren.|El Museo de [town] abre hoy.|La calle estaba vacía.
Nous partons à [town].|Le marché de [town] est fermé.|C'est la rue la plus calme.|[cword]很重要。|今天討論[cword]。|關於[cword]的筆記|[cword]和[cword]|買了[cword]|喜歡[cword]的味道|[cword]變多了|明天去[cplace]|整理[cword]清單|為了[cword]努力|從[cplace]到[town]|花了[n]分鐘|第[n]章|住在[cplace]|[cplace]的夏天
[cplace]離這裡不遠。|到[cplace]出差|問[cword]在哪裡|跟[cword]有關|[cword]說明|是[cword]的緣故|我和[cword]|把[cword]放好|找[cword]|陪孩子看[cword]|昨天[cword]壞了|[cword]旁邊|沒有[cword]也行|因為[cword]|那[n]個人|[cword]，[cword]，[cword]|[org] said no.|Ask at [org].
[town] [org] closed early.|[town]: [n] to [n]|the [org] of [town]|Letters to [town]|My favourite is [place].|a day in [town] with [n] of us|I live in [town].|[place] never sleeps.|Send it to [org].|moved to [town] in [year]|号[n][n]|pages [n]-[n]|[n]% off at [org]|call it a day|write it down|number [n]|id [n]|card [n] of [n]
mail room, floor [n]|The address is unknown.|phone off|Wi-Fi: [lword][n]|Platform [n] at [time]|Between [place] and [place] lies a field.|[place] or [place]?|Every [weekday], [place] smells of bread.|Radio plays [word] [word].|Then [place]; then home.|wrote 'for row in data:'|print(total, [n][n])|[n][n] [n][n] [n][n]|grid [n], cell [n]
row [n] col [n] = [n][n][n]|Each Spring the River rises.|Schöne Grüße aus [town]|Todo cambia con el Tiempo|Un Día en [town]|Les Jardins de [town]"""  # fmt: skip
GIVEN = "Laura Thomas Jane Peter Robert Isabella Christopher Deborah Nicholas Margaret Benjamin Eleanor Gabriel Charlotte William Samantha Victoria Francisco Ursula Henry Daniela Theodore Matilda Sam Kate Tim Debbie Bob Nick Meg Ben Nell".split()
UNLISTED = "Zbigniew Oluwaseun Ingrid Takumi Priya Anselm Beatriz Yewande Torsten Milica Kasimir Noor Esperanza Lotte Jarek Amina Siobhan Ravi Leocadia Hamza".split()
#: Family names made of syllables, like none that is listed.
SYLLABLES = "ba be do fen gar hol ik jan kel lor mun nav ost per ril sab tov uk vel wim yar zed".split()
FAMILY = "Abernathy Bellweather Castellano Drummond Eversleigh Falkenrath Gonzaga Hartnell Iverson Jankowski Kestrelli Lindqvist Montague Nakamura Ostrander Pellegrino Quimby Rosenthal Szymanski Thackeray Kowalski Weatherby Okonkwo Brandvold Delacroix O'Hara Villanueva Stein Haas Moreau".split()
#: Family names of the examples that count as known; so do those learnt from a table of people.
KNOWN_FAMILY = frozenset(f.lower() for f in FAMILY[::2])
TOWNS = "Ashbourne Kirkwall Norbury Elmstead Wexcombe Thornley Oakmere Lindholm Brackwell Farndale Stonegate Marlow Eastvale Hartwick Porto Bergen Granada Lyon Weimar Utrecht".split()
WORDS = "Lantern Harbour Kettle Silver Winter Compass Orchard Paper Thunder Velvet Amber Signal Granite Meadow".split()
STREET_WORDS = "Street St. Road Rd Avenue Ave Lane Close Crescent Drive Court Terrace Square".split()
HOSTS = "post.example mail.test office.invalid mail.north.example webbox.test letters-hub.example uni.example.org firma.test correo.invalid".split()
CJK_FAMILY = "王林陳張李黃吳劉許謝周徐趙楊高江馬夏白葉溫石方金洪曾"
CJK_GIVEN, CJK_SELDOM = "怡君志豪雅婷家瑋淑芬俊傑建宏美玲欣妤承翰冠宇詩涵子軒明華國文英秀玉惠", "岳川楓棋鴻鵬燕莉菲樂藍海星松竹舟"
COMPOUND = ("歐陽", "司馬", "諸葛", "上官")
# Common words that begin with the sign of a family name, and places that do.
CWORDS = (
    "高興 高度 方法 方便 方向 江水 馬上 馬路 周末 周圍 夏天 夏季 林木 黃色 黃昏 白天 白色 金錢 金魚 石頭 溫度 溫柔 葉子 葉片 施工 洪水 許多 許願 田野 任何 任務 程式 程度 顏色 包裹 平常 文章 文化 水果 安全 "
    "安靜 和平 孔雀 雷聲 雷雨 湯匙 毛巾 毛衣 龍頭 車站 張開 張貼 陳列 楊柳 孫子 胡椒 何時 何處 羅盤 鄭重 謝意 宋朝 唐詩 曾經 董事 余地 杜鵑 蘇打 丁香 沈重 沈默 姜餅 鍾愛 陸地 陸續 汪洋 武術 戴上 莫非 向前 "
    "史料 陶器 黎明 賀卡 顧客 萬一 錢包 嚴格 嚴重 童年 康復 季節 常常 符號 房間 紀念 紀錄 賴床 游泳 歐洲 管理 時間 成員 關於 簡單 申請 牛奶 尤其 祝福 景色 單字 焦點 容易 印象 李子 王子 王國 吳語"
).split()
#: Two of three of these words count as known in the examples.
KNOWN_WORDS = frozenset(w for k, w in enumerate(CWORDS) if k % 3)
CPLACES = "金門 高雄 馬祖 林口 黃山 江南 方家村 石門 白河 田中 金山 溫州 洪湖 台北 花蓮 東港 南灣 新北".split()


def _digits(r: random.Random, shape: str) -> str:
    return re.sub("#", lambda _: r.choice("0123456789"), shape)


def _email(r: random.Random) -> str:
    given, family = r.choice(GIVEN + UNLISTED), r.choice(FAMILY).replace("'", "")
    local = r.choice([f"{given}.{family}", f"{family}-{given}", f"{given}{_digits(r, '###')}", f"{given[0]}{family}", f"{family}_{_digits(r, '##')}", f"{given}+news", f"info{_digits(r, '#')}"]).lower()
    host = r.choice(HOSTS)
    mail = r.choice([f"{local}@{host}"] * 5 + [f"{local} (at) {host}", f"{local}[at]{host}", f"{local} @ {host}", f"{local} at {host.replace('.', ' dot ')}", f"{local}(at){host.replace('.', '(dot)')}"])
    return mail.upper() if r.random() < 0.1 else mail


def _phone(r: random.Random) -> str:
    shapes = "+44 7### 9## ###|07### 9#####|020 7### ####|(###) 555 ####|###.555.####|###-555-####|1-###-555-####|+1 (###) 555-####|+886 9## ### ###|09##-###-###|09########|09## ### ###|(02) ####-####|02-####-####|+33 6 ## ## ## ##|01 ## ## ## ##|+49 30 ########|030 ##### ###|0170/#######|+34 6## ### ###|6## ## ## ##|+44 20 7### #### ext. ##|+1-###-###-#### x###"
    number = _digits(r, r.choice(shapes.split("|")))
    return number.translate({ord(c): 0xFEE0 + ord(c) for c in "0123456789"}) if r.random() < 0.05 else number


def _ident(r: random.Random) -> str:
    shape = r.choice("A2########|B1########|A###-######|QQ######C|QQ ## ## ## C|X#######L|Y-#######-L|########L|9##-##-####|9## ## ####|A########|AB#######|L##XX##X#".split("|"))
    ident = re.sub("[AXLB]", lambda m: r.choice("ABCDEFGHKLMP"), _digits(r, shape))
    return ident.lower() if r.random() < 0.05 else ident


def _address(r: random.Random) -> str:
    town, family = r.choice(TOWNS), r.choice(FAMILY).replace("'", "")
    n = str(r.randint(1, 240)) + r.choice(["", "", "", "A", "b"])
    street = f"{r.choice(['', '', 'Old ', 'Upper '])}{r.choice([town, family, 'Garden', 'Mill', 'Lamp', 'Station', 'High'])} {r.choice(STREET_WORDS)}"
    tail = r.choice(["", "", f", Apt {r.randint(1, 40)}", f", {r.choice(TOWNS)}", f", {r.choice(TOWNS)} X{r.randint(1, 9)} {r.randint(1, 9)}QX", f" #{r.randint(1, 40)}"])
    english = f"{r.choice(['', '', '', f'Flat {r.randint(1, 40)}, ', f'Unit {r.randint(1, 9)}, '])}{n} {street}{tail}"
    han = f"{r.choice(['', '新北市', '青山市', '東港市', '台中縣'])}{r.choice(['', '大安區', '河西區', '南灣鄉'])}{r.choice(['中山路', '花園街', '松江路', '和平東路', '文化大道'])}{r.choice(['', '二段', '三段'])}{r.choice(['', f'{r.randint(2, 99)}巷'])}{r.choice(['', f'{r.randint(2, 30)}弄'])}{r.randint(1, 300)}號{r.choice(['', f'{r.randint(2, 9)}樓', f'{r.randint(2, 9)}樓之{r.randint(1, 5)}'])}"
    other = [
        f"{r.randint(1, 99)}{r.choice(['', ' bis'])}{r.choice([',', ''])} {r.choice(['rue', 'avenue', 'chemin', 'quai', 'boulevard'])} {r.choice(['du ', 'de la ', 'des ', ''])}{family}",
        f"{family}{r.choice(['straße', 'gasse', 'weg', 'platz', 'allee'])} {r.randint(1, 99)}{r.choice(['', 'a', 'b'])}{r.choice(['', f', {_digits(r, '#####')} {town}'])}",
        f"{r.choice(['calle', 'avenida', 'plaza', 'Calle', 'C/'])} {r.choice(['de ', 'del ', ''])}{family},{r.choice([' ', ' n.º '])}{r.randint(1, 99)}",
    ]
    return r.choice([english] * 4 + [han] * 2 + other)


def _name(r: random.Random) -> tuple[str, str]:
    """A title or nothing, and the name."""
    given, family = r.choice(GIVEN if r.random() < 0.7 else UNLISTED), r.choice(FAMILY)
    if r.random() < 0.3:
        family = "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 4))).capitalize()
    name = r.choice([f"{given} {family}"] * 5 + [given, given, f"{given[0]}. {family}", f"{given[0]}. {family}", f"{family}, {given}", f"{given} {r.choice('ABCDEF')}. {family}", f"{family}, {given[0]}."])
    title = ""
    if r.random() < 0.22:
        title, name = r.choice(["Dr. ", "Mrs ", "Mr ", "Mr. ", "Prof. ", "Ms ", "Frau ", "Herr ", "Mme ", "Coach ", "Dr. ", "Mrs. "]), r.choice([family, f"{given} {family}"])
    return title, name.upper() if r.random() < 0.1 and "." not in name else name


def _cjk_name(r: random.Random) -> str:
    signs = CJK_GIVEN if r.random() < 0.93 else CJK_SELDOM
    first = r.choice(COMPOUND) if r.random() < 0.05 else r.choice(CJK_FAMILY)
    return first + "".join(r.choice(signs) for _ in range(1 if r.random() < 0.12 else 2))


def _harmless(kind: str, r: random.Random) -> str:
    town, word = r.choice(TOWNS), r.choice(WORDS)
    place = [town, f"{town} Library", f"Old {town}", f"Lake {town}", f"Radio {town}", f"{town} Bay", f"{town} Hill", f"Port {town}", f"the Blue {word}", f"Mount {town}", f"{town} {r.choice(['Street', 'Road', 'Square'])}"]
    org = [f"{town} Library", f"{word} Club", f"{town} Choir", f"{r.choice(['Chess', 'Garden', 'Rowing', 'Film'])} Club", f"{word} {r.choice(['Café', 'Bakery', 'Museum', 'Hotel', 'School'])}", f"University of {town}", f"{word} & {r.choice(WORDS)} Ltd", f"{town} Hospital"]
    plain = {"town": [town], "place": place, "org": org, "word": [word], "lword": [word.lower()], "weekday": "Monday Tuesday Friday Sunday Montag Samstag".split(), "cword": CWORDS, "cplace": CPLACES}
    if kind in plain:
        return r.choice(plain[kind])
    shape = {
        "invoice": "INV-2025####", "isbn": "978-0-###-#####-#", "track": "TRK ### #### ####", "order": "A##-####", "time": "1#:3#", "version": "#.#.##", "ticket": "###-####", "ip": "192.0.2.1##", "money": "#,###", "flight": "XQ###", "year": "19##",
    }.get(kind)
    if shape:
        return _digits(r, shape)
    return {"n": str(r.randint(1, 99)), "date": f"20{_digits(r, '##')}-{r.randint(10, 12)}-{r.randint(10, 28)}", "sha": "".join(r.choice("0123456789abcdef") for _ in range(8))}[kind]


MAKERS = {"email": _email, "phone": _phone, "id": _ident, "address": _address, "cjk": _cjk_name}
ALL = [(kind, frame.replace("¶", "\n")) for kind, frames in FRAMES.items() for frame in re.split(r"[|\n]", frames) if frame]
PLAIN = [frame for frame in re.split(r"[|\n]", HARMLESS) if frame]


def _sentence(kind: str, frame: str, r: random.Random) -> tuple[str, list[tuple[int, int, str]]]:
    text, truth = "", []
    for part in re.split(r"(\{\}|\[\w+\])", frame):
        if part == "{}":
            title, value = _name(r) if kind == "name" else ("", MAKERS[kind](r))
            text += title
            truth.append((len(text), len(text) + len(value), "name" if kind == "cjk" else kind))
            text += value
        elif part[:1] == "[" and part[1:-1].isalpha():
            text += _harmless(part[1:-1], r)
        else:
            text += part
    return text, truth


def example(number: int, seed: int) -> tuple[bool, str, set[tuple[int, int, str]]]:
    """The ``number``-th text: whether its frames are among the fifth that is left out of the fit, the text, and the spans that
    are personal information."""
    r = random.Random(f"{seed} {number}")
    held = number % 5 == 0
    own = [f for k, f in enumerate(ALL) if (k % 5 == 0) == held]
    plain = [f for k, f in enumerate(PLAIN) if (k % 5 == 0) == held]
    text, truth = "", set()
    for k in range(r.choice([1, 1, 2, 3])):
        kind, frame = r.choice(own) if r.random() < 0.6 else ("", r.choice(plain))
        part, spans = _sentence(kind, frame, r)
        if k:
            text += r.choice([" ", " ", "\n", "; " if not part[:1].isupper() else ". "])
        truth |= {(len(text) + a, len(text) + b, kind) for a, b, kind in spans}
        text += part
    return held, text, truth


def examples(count: int, seed: int) -> Iterator[tuple[bool, str, set[tuple[int, int, str]]]]:
    for number in range(count):
        yield example(number, seed)
