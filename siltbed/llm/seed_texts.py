"""Running text in nine languages from public or own sources, none of it from any table.

``DECLARATION`` holds the opening articles of the Universal Declaration of Human Rights (public
text); ``PARTS`` are subjects, predicates, objects and endings of everyday sentences.
"""

from __future__ import annotations

import random

# Text as published.
DECLARATION = {
    "eng": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. Everyone has the right to life, liberty and security of person. No one shall be held in slavery or servitude; slavery and the slave trade shall be prohibited in all their forms. Everyone has the right to recognition everywhere as a person before the law.",
    "deu": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder Leibeigenschaft gehalten werden; Sklaverei und Sklavenhandel sind in allen ihren Formen verboten. Jeder hat das Recht, überall als rechtsfähig anerkannt zu werden.",
    "fra": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude; l’esclavage et la traite des esclaves sont interdits sous toutes leurs formes. Chacun a le droit à la reconnaissance en tous lieux de sa personnalité juridique.",
    "spa": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. Nadie estará sometido a esclavitud ni a servidumbre; la esclavitud y la trata de esclavos están prohibidas en todas sus formas. Todo ser humano tiene derecho, en todas partes, al reconocimiento de su personalidad jurídica.",
    "ita": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. Nessun individuo potrà essere tenuto in stato di schiavitù o di servitù; la schiavitù e la tratta degli schiavi saranno proibite sotto qualsiasi forma. Ogni individuo ha diritto, in ogni luogo, al riconoscimento della sua personalità giuridica.",
    "por": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Todo o indivíduo tem direito à vida, à liberdade e à segurança pessoal. Ninguém será mantido em escravatura ou em servidão; a escravatura e o trato dos escravos, sob todas as formas, são proibidos. Todos os indivíduos têm direito ao reconhecimento, em todos os lugares, da sua personalidade jurídica.",
    "nld": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. Een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon. Niemand zal in slavernij of horigheid gehouden worden. Slavernij en slavenhandel in iedere vorm zijn verboden. Een ieder heeft, waar hij zich ook bevindt, het recht als persoon erkend te worden voor de wet.",
    "pol": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Każdy człowiek ma prawo do życia, wolności i bezpieczeństwa swej osoby. Nie wolno nikogo czynić niewolnikiem ani nakładać na nikogo służebności; niewolnictwo i handel niewolnikami są zakazane we wszystkich swych postaciach. Każdy człowiek ma prawo do uznawania wszędzie jego osobowości prawnej.",
    "rus": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность. Никто не должен содержаться в рабстве или в подневольном состоянии; рабство и работорговля запрещаются во всех их видах. Каждый человек, где бы он ни находился, имеет право на признание его правосубъектности.",
}

# Own sentences in parts: subjects, predicates, objects, endings.
_PARTS = {
    "eng": ("Our neighbour|The librarian|A young engineer|My sister|The whole team|This program|An old printer|The museum|Somebody from accounting|The new intern|Every driver|The weather report|One of the volunteers|The update|That filter|A second copy|The archive", "bought|describes|needed|carried|fixed|never mentions|will open|explains|has moved|prints|compares|cleaned|wrote down|kept|could not find|stores|reads back", "a box of postcards|the kitchen window|three wooden chairs|the minutes of the meeting|all the spare keys|a map of the valley|the annual budget|our holiday pictures|the garden gate|two cups of tea|the full report|every saved message|the list of folders|a damaged file|the hard disk|an index of names|some free space|the oldest backup", "|before the rain came|because it was late|in the afternoon|with great care|after the last update|without asking anyone|near the river|one more time|as far as we know|while the machine was running|at the end of the month|when the cable came loose"),
    "deu": ("Unsere Nachbarin|Der Bibliothekar|Eine junge Ingenieurin|Mein Bruder|Die ganze Mannschaft|Dieses Programm|Ein alter Drucker|Das Museum|Jemand aus der Buchhaltung|Der neue Praktikant|Jeder Fahrer|Das Archiv|Die Aktualisierung|Eine zweite Kopie", "kauft|beschreibt|braucht|trägt|erwähnt nie|öffnet später|erklärt|druckt|vergleicht|reinigt|notiert|behält|findet nicht|speichert|liest", "eine Schachtel mit Postkarten|das Küchenfenster|drei Stühle aus Holz|die Niederschrift der Sitzung|alle Ersatzschlüssel|eine Karte des Tals|den Haushalt für nächstes Jahr|unsere Urlaubsbilder|das Gartentor|zwei Tassen Tee|den vollständigen Bericht|jede gespeicherte Nachricht|die Liste der Ordner|eine beschädigte Datei|die Festplatte|das älteste Backup|etwas freien Speicher", "|bevor der Regen kam|weil es schon spät war|am Nachmittag|mit großer Sorgfalt|nach dem letzten Neustart|ohne jemanden zu fragen|in der Nähe des Flusses|noch einmal|soweit wir wissen|während die Maschine lief|am Ende des Monats"),
    "fra": ("Notre voisine|Le bibliothécaire|Une jeune ingénieure|Mon frère|Toute l’équipe|Ce programme|Une vieille imprimante|Le musée|Quelqu’un de la comptabilité|Le nouveau stagiaire|Chaque conducteur|La mise à jour|Une deuxième copie|L’archive", "achète|décrit|demande|porte|ne mentionne jamais|ouvrira|explique|imprime|compare|nettoie|note|garde|ne trouve pas|enregistre|relit", "une boîte de cartes postales|la fenêtre de la cuisine|trois chaises en bois|le compte rendu de la réunion|toutes les clés de rechange|une carte de la vallée|le budget de l’année|nos photos de vacances|la porte du jardin|deux tasses de thé|le rapport complet|chaque message enregistré|la liste des dossiers|un fichier abîmé|le disque dur|la plus ancienne sauvegarde|un peu d’espace libre", "|avant l’arrivée de la pluie|parce qu’il était tard|dans l’après-midi|avec beaucoup de soin|après le dernier redémarrage|sans demander à personne|près de la rivière|encore une fois|autant que nous sachions|pendant que la machine tournait|à la fin du mois"),
    "spa": ("Nuestra vecina|El bibliotecario|Una joven ingeniera|Mi hermano|Todo el equipo|Este programa|Una impresora vieja|El museo|Alguien de contabilidad|El nuevo becario|Cada conductor|La actualización|Una segunda copia|El archivo", "compra|describe|necesita|lleva|nunca menciona|abrirá|explica|imprime|compara|limpia|anota|guarda|no encuentra|almacena|lee", "una caja de postales|la ventana de la cocina|tres sillas de madera|el acta de la reunión|todas las llaves de repuesto|un mapa del valle|el presupuesto del año|nuestras fotos de vacaciones|la puerta del jardín|dos tazas de té|el informe completo|cada mensaje guardado|la lista de carpetas|un fichero roto|el disco duro|la copia más antigua|algo de espacio libre", "|antes de que llegara la lluvia|porque ya era tarde|por la tarde|con mucho cuidado|después del último reinicio|sin preguntar a nadie|cerca del río|otra vez|hasta donde sabemos|mientras la máquina funcionaba|a finales de mes"),
    "ita": ("La nostra vicina|Il bibliotecario|Una giovane ingegnera|Mio fratello|Tutta la squadra|Questo programma|Una vecchia stampante|Il museo|Qualcuno della contabilità|Il nuovo tirocinante|Ogni autista|L’aggiornamento|Una seconda copia|L’archivio", "compra|descrive|chiede|porta|non cita mai|aprirà|spiega|stampa|confronta|pulisce|annota|conserva|non trova|salva|rilegge", "una scatola di cartoline|la finestra della cucina|tre sedie di legno|il verbale della riunione|tutte le chiavi di scorta|una mappa della valle|il bilancio dell’anno|le nostre foto delle vacanze|il cancello del giardino|due tazze di tè|la relazione completa|ogni messaggio salvato|l’elenco delle cartelle|un file rovinato|il disco rigido|la copia più vecchia|un po’ di spazio libero", "|prima che arrivasse la pioggia|perché era tardi|nel pomeriggio|con molta cura|dopo l’ultimo riavvio|senza chiedere a nessuno|vicino al fiume|ancora una volta|per quanto ne sappiamo|mentre la macchina girava|alla fine del mese"),
    "por": ("A nossa vizinha|O bibliotecário|Uma jovem engenheira|O meu irmão|Toda a equipa|Este programa|Uma impressora velha|O museu|Alguém da contabilidade|O novo estagiário|Cada motorista|A atualização|Uma segunda cópia|O arquivo", "compra|descreve|precisa de|leva|nunca menciona|abrirá|explica|imprime|compara|limpa|anota|guarda|não encontra|armazena|lê", "uma caixa de postais|a janela da cozinha|três cadeiras de madeira|a ata da reunião|todas as chaves de reserva|um mapa do vale|o orçamento do ano|as nossas fotos de férias|o portão do jardim|duas chávenas de chá|o relatório completo|cada mensagem guardada|a lista de pastas|um ficheiro estragado|o disco rígido|a cópia mais antiga|algum espaço livre", "|antes de chegar a chuva|porque já era tarde|durante a tarde|com muito cuidado|depois do último arranque|sem perguntar a ninguém|perto do rio|mais uma vez|tanto quanto sabemos|enquanto a máquina trabalhava|no fim do mês"),
    "nld": ("Onze buurvrouw|De bibliothecaris|Een jonge ingenieur|Mijn broer|Het hele team|Dit programma|Een oude printer|Het museum|Iemand van de boekhouding|De nieuwe stagiair|Elke chauffeur|De update|Een tweede kopie|Het archief", "koopt|beschrijft|vraagt|draagt|noemt nooit|opent straks|verklaart|drukt|vergelijkt|reinigt|noteert|houdt|vindt niet|leest", "een doos ansichtkaarten|het raam van de keuken|drie houten stoelen|de notulen van het overleg|alle reservesleutels|een kaart van het dal|de begroting van dit jaar|onze vakantiefoto’s|het hek van de tuin|twee koppen thee|het volledige rapport|ieder bewaard bericht|de lijst met mappen|een beschadigd bestand|de harde schijf|de oudste back-up|wat vrije ruimte", "|voordat de regen kwam|omdat het al laat was|in de middag|met grote zorg|na de laatste herstart|zonder iemand te vragen|dicht bij de rivier|nog een keer|voor zover wij weten|terwijl de machine draaide|aan het eind van de maand"),
    "pol": ("Nasza sąsiadka|Pewien bibliotekarz|Młoda inżynierka|Mój brat|Cały zespół|Ten program|Stara drukarka|Muzeum|Ktoś z księgowości|Nowy stażysta|Każdy kierowca|Aktualizacja|Druga kopia|Archiwum", "kupuje|opisuje|nosi|nigdy nie wspomina|otworzy|wyjaśnia|drukuje|porównuje|czyści|notuje|trzyma|nie może znaleźć|zapisuje|czyta", "pudełko pocztówek|okno w kuchni|trzy drewniane krzesła|protokół z zebrania|wszystkie zapasowe klucze|mapę doliny|budżet na ten rok|nasze zdjęcia z wakacji|furtkę do ogrodu|dwie filiżanki herbaty|pełny raport|każdą zapisaną wiadomość|listę katalogów|uszkodzony plik|twardy dysk|najstarszą kopię|trochę wolnego miejsca", "|zanim przyszedł deszcz|bo było już późno|po południu|z wielką starannością|po ostatnim uruchomieniu|nie pytając nikogo|blisko rzeki|jeszcze raz|o ile nam wiadomo|kiedy maszyna pracowała|pod koniec miesiąca"),
    "rus": ("Наша соседка|Библиотекарь|Молодой инженер|Мой брат|Вся команда|Эта программа|Старый принтер|Музей|Кто-то из бухгалтерии|Новый стажёр|Каждый водитель|Обновление|Вторая копия|Архив", "покупает|описывает|несёт|никогда не упоминает|откроет|объясняет|печатает|сравнивает|моет|записывает|хранит|не может найти|сохраняет|читает", "коробку открыток|окно на кухне|три деревянных стула|протокол собрания|все запасные ключи|карту долины|бюджет на этот год|наши снимки из отпуска|садовую калитку|две чашки чая|полный отчёт|каждое сообщение|список папок|испорченный файл|жёсткий диск|самую старую копию|немного свободного места", "|пока не пошёл дождь|потому что было поздно|после обеда|очень осторожно|после последнего запуска|никого не спросив|недалеко от реки|ещё один раз|насколько нам известно|пока машина работала|в конце месяца"),
}
PARTS = {k: [part.split("|") for part in v] for k, v in _PARTS.items()}


def sentence(r: random.Random, lang: str, subject: str | None = None) -> str:
    s, v, o, e = PARTS[lang]
    text = f"{subject or r.choice(s)} {r.choice(v)} {r.choice(o)}"
    end = r.choice(e) if r.random() < 0.5 else ""
    return f"{text} {end}" if end else text


def seeds(n: int = 14, seed: int = 3) -> dict[str, list[str]]:
    """A few texts of each language: the declaration and some sentences."""
    r = random.Random(seed)
    return {k: [DECLARATION[k], *[sentence(r, k) for _ in range(n)]] for k in PARTS}
