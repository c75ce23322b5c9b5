"""Wrong encodings: texts in many languages, clean and spoilt, and searches that must end."""

import random
import time

import pytest

from dumpquarry.llm import mojibake

SENTENCES = {
    "sv": "Jag åt smörgåsar på Öland förra året.",
    "sv2": "Hur många rader saknas efter återställningen? Vi behöver göra om körningen på måndag.",
    "no": "Vi må gjøre om kjøringen på mandag, fordi to tabeller ble tomme etter gjenopprettingen. Rådataene står på gårdens tjener ved sjøen.",
    "da": "Hvor mange rækker mangler efter genoprettelsen? Vi må køre opgaven igen på søndag, og gøre det ordentligt.",
    "fi": "Kuinka monta riviä puuttuu palautuksen jälkeen? Ajamme työn uudelleen tänä yönä.",
    "et": "Mitu rida on pärast taastamist puudu? Õhtul käivitame töö uuesti, külm öö jätab jälje.",
    "cs": "Kolik řádků po obnovení chybí? Příští týden spustíme úlohu znovu, protože dvě tabulky zůstaly prázdné. Nový výpis byl těžký.",
    "sk": "Koľko riadkov po obnovení chýba? Budúci týždeň spustíme úlohu znova, lebo dve tabuľky zostali prázdne.",
    "hu": "Hány sor hiányzik a visszaállítás után? Hétfőn újra elindítjuk a műveletet, mert két tábla üres maradt. Köszönöm szépen!",
    "ro": "Câte rânduri lipsesc după restaurare? Vom porni din nou lucrarea săptămâna viitoare, fiindcă două tabele au rămas goale și nu știm de ce.",
    "hr": "Koliko redaka nedostaje nakon vraćanja? Sljedeći tjedan ponovno ćemo pokrenuti posao jer su dvije tablice ostale prazne. Čuvajte sigurnosnu kopiju, može zatrebati šest ključeva.",
    "sl": "Koliko vrstic manjka po obnovitvi? Naslednji teden bomo opravilo znova zagnali, ker sta dve tabeli ostali prazni. Žal še ne vemo, zakaj je prišlo do okvare čez noč.",
    "lt": "Kiek eilučių trūksta po atkūrimo? Kitą savaitę darbą paleisime iš naujo, nes dvi lentelės liko tuščios.",
    "lv": "Cik rindu trūkst pēc atjaunošanas? Nākamnedēļ darbu palaidīsim vēlreiz, jo divas tabulas palika tukšas.",
    "is": "Hversu margar raðir vantar eftir endurheimtina? Við keyrum verkið aftur á þriðjudag því tvær töflur urðu tómar. Þær voru mjög stórar.",
    "is2": "Veðrið versnaði um kvöldið svo báturinn varð eftir í höfninni. Nágranni okkar selur epli.",
    "it": "Perché mancano così tante righe? La città è già più lontana; però il caffè è buono.",
    "ca": "Quantes files falten després de la restauració? Això no és normal, però l’any vinent ho farem més bé. Les col·leccions són plenes.",
    "nl": "De coördinatie van de geïmporteerde tabellen is één keer mislukt; dat is financiële onzin, reëel bezien.",
    "uk": "Скільки рядків бракує після відновлення? Наступного тижня ми знову запустимо завдання, бо дві таблиці залишилися порожніми. Її ім’я невідоме.",
    "bg": "Колко реда липсват след възстановяването? Следващата седмица ще пуснем задачата отново, защото две таблици останаха празни. Щъркелът не долетя.",
    "sr": "Колико редова недостаје после обнављања? Следеће недеље ћемо поново покренути посао, јер су две табеле остале празне. Љубав и њива.",
    "el": "Πόσες γραμμές λείπουν μετά την επαναφορά; Την επόμενη εβδομάδα θα ξεκινήσουμε ξανά την εργασία, επειδή δύο πίνακες έμειναν κενοί.",
    "vi": "Có bao nhiêu hàng bị thiếu sau khi khôi phục? Tuần tới chúng tôi sẽ chạy lại công việc vì hai bảng vẫn còn trống.",
    "ko": "복원 후에 빠진 행이 몇 개입니까? 두 테이블이 비어 있으므로 다음 주에 작업을 다시 실행하겠습니다.",
    "zh": "恢复之后缺少多少行？由于两个表是空的，我们下周将重新运行该任务。请检查备份文件的编码。",
    "zht": "還原之後缺少多少列？由於兩個資料表是空的，我們下週將重新執行這項工作。請檢查備份檔案的編碼。",
    "ja": "復元のあとで何行が足りませんか。二つの表が空なので、来週もう一度作業を実行します。",
    "ar": "كم عدد الصفوف المفقودة بعد الاستعادة؟ سنعيد تشغيل المهمة الأسبوع القادم.",
    "he": "כמה שורות חסרות לאחר השחזור? נריץ שוב את המשימה בשבוע הבא.",
    "th": "มีกี่แถวที่หายไปหลังจากกู้คืน เราจะเรียกใช้งานอีกครั้งในสัปดาห์หน้า",
    "hi": "पुनर्स्थापना के बाद कितनी पंक्तियाँ गायब हैं? हम अगले सप्ताह कार्य फिर से चलाएँगे।",
    "de": "Wie viele Zeilen fehlen nach der Wiederherstellung? Nächste Woche läuft die Aufgabe erneut, weil zwei Tabellen übrig geblieben sind. Größe und Maß, süß.",
    "pl": "Ile wierszy brakuje po przywróceniu? W przyszłym tygodniu uruchomimy zadanie ponownie, ponieważ dwie tabele pozostały puste. Źdźbło, gęś, łódź.",
    "tr": "Geri yüklemeden sonra kaç satır eksik? İki tablo boş kaldığı için gelecek hafta işi yeniden çalıştıracağız.",
    "es": "¿Cuántas filas faltan después de la restauración? La próxima semana ejecutaremos la tarea de nuevo, señor Núñez, porque dos tablas quedaron vacías.",
    "pt": "Quantas linhas faltam após a restauração? Na próxima semana executaremos a tarefa de novo, porque duas tabelas ficaram vazias. Não há exceções.",
    "fr": "Combien de lignes manquent après la restauration ? La semaine prochaine, nous relancerons la tâche, car deux tables sont restées vides. Cœur, maïs, où, être, français.",
    "ru": "Сколько строк не хватает после восстановления? На следующей неделе мы снова запустим задание, потому что две таблицы остались пустыми.",
}


def spoil(text, wrong):
    """The UTF-8 bytes of a text read in another encoding; bytes that it leaves undefined show as C1 controls."""
    return "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in text.encode())


@pytest.mark.parametrize("language", SENTENCES)
def test_clean_texts_of_other_languages_are_no_cases(language):
    assert mojibake.examine(SENTENCES[language], True) == (False, SENTENCES[language], "")


@pytest.mark.parametrize("wrong", ["cp1252", "cp437", "cp1251", "mac_roman"])
def test_spoilt_texts_of_other_languages(wrong):
    got = {k: mojibake.examine(spoil(t, wrong), True) for k, t in SENTENCES.items()}
    assert [k for k, g in got.items() if not g[0]] == []
    assert sum(g[1] == SENTENCES[k] for k, g in got.items()) >= 0.8 * len(SENTENCES)


def test_search_of_partly_spoilt_text_ends():
    proper, after = "Спасибо, Elmi ", "В версии 1.6.4 исправлена ошибка при чтении ключей из revisions."
    begun = time.process_time()
    assert mojibake.examine(proper + spoil(after, "cp1251"), True)[:2] == (True, proper + after)
    assert time.process_time() - begun < 10


def test_search_of_garbage_ends():
    rng = random.Random(7)
    begun = time.process_time()
    for first in (0xA0, 0x400, 0x2500):
        text = "".join(rng.choice([chr(first + rng.randrange(128)), " ", "a"]) for _ in range(2000))
        mojibake.search(text)
    assert time.process_time() - begun < 30


@pytest.mark.parametrize("text", ["（orchard_439.csv、7行目）テーブルを復元しました。", "file.sql：MySQLへの取り込みは、62分かかりました。", "²バックアップと元のデータ"])
def test_full_width_marks_start_no_search(text):
    assert mojibake.cost(text) == 0


def test_spoilt_part_beside_proper_japanese():
    proper, after = "テーブルを復元しました。", "文字コードの設定を確認してください"
    lossy = after.encode().decode("gbk", "replace")
    assert "�" in lossy
    found, restored, _ = mojibake.examine(proper + lossy, True)
    assert found and restored.startswith(proper + after[:6])


def test_spoilt_quotation_marks_are_found():
    text = "Since then the order command reads “categories” before “posts”."
    assert mojibake.examine(text.translate({0x201C: "ô", 0x201D: "ö"}), True)[:2] == (True, text)


def test_a_cost_beyond_its_limit_ends_early():
    text = spoil("Повторный запуск занял минуты. ", "cp1251") * 50
    assert 3 < mojibake.cost(text, limit=3) < mojibake.cost(text) / 10
