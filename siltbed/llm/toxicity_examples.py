"""Labelled sentences for the toxicity model, drawn from a grammar; made-up groups, no real ones.

Written from general knowledge of what abuse looks like, not from any table: insults, threats and
wishes of harm against a person, demeaning a group, sexual content; against anger at devices or at oneself,
technical and medical uses of rough words, and reports of abuse or rules against it.
"""

from __future__ import annotations

import random

from siltbed.llm.pii_examples import THINGS
from siltbed.llm.seed_texts import PARTS, sentence

INSULT = "idiot moron loser cretin scumbag halfwit parasite bastard clown imbecile fool maggot worm pig rat coward liar creep jerk dimwit dunce freak weasel slug asshole bitch dickhead prick wanker twat dumbass snake leech troll pervert".split() + ["piece of shit", "waste of skin", "sack of garbage", "excuse for a human", "little nobody"]
RUDE = "pathetic worthless disgusting brainless spineless miserable lying ignorant stupid useless filthy ugly rotten dumb wretched vile sad dirty revolting fat lazy greasy retarded clueless hopeless despicable".split()
STEMS = "Ald Bor Cal Dre Eln Fal Gor Har Jol Kev Lor Mer Nev Ol Pra Quen Ros Sed Tav Uld Vor Wes Yar Zan".split()
GROUP = [a + b for a in STEMS[::2] for b in ("ians", "ish", "ari", "folk")] + ["immigrants", "foreigners", "refugees", "outsiders", "northerners", "southerners", "mountain people", "coast people", "gypsies", "peasants", "newcomers", "their kind", "that race", "those people"]
ANIMAL = "vermin rats animals filth parasites pests lice cockroaches beasts scum dogs maggots pigs subhumans".split()
ACTOR = ["a naked nurse", "a horny couple", "two lesbians", "a muscular gardener", "my best friend's wife", "a sexy student", "a nude dancer", "a busty blonde", "my naked girlfriend", "three horny guys", "her stepbrother", "a stripper", "the hot waitress", "strangers"]
ACT = ["sex", "oral sex", "rough sex", "hot sex", "loud sex", "group sex", "anal sex", "a blowjob", "hardcore porn", "kinky sex", "an orgy", "naked massage", "a threesome", "wild sex"]
PLACE = ["in the shower", "on the sofa", "in the back of the car", "tonight", "all night long", "on camera", "in the office", "in bed", "on the kitchen table", "until sunrise", "at the beach"]
DEVICE = "drive disk controller cable firmware server enclosure laptop platter scanner imager tool printer router script installer keyboard monitor battery adapter kernel compiler browser".split()
STATE = "refurbished dropped noisy encrypted slow overheated old damaged full brand-new cheap second-hand borrowed".split()

ABUSIVE = [
    "You {r} {i}.", "You are a {r} {i}.", "you {i}", "You {r}, {r} {i}, {d}.", "Shut up, {i}.", "Shut your mouth, you {r} {i}.", "Get lost, {i}.", "Go to hell, you {r} {i}.", "Drop dead, {i}.", "Kill yourself, {i}.", "kys", "Fuck you, {i}.", "fuck off, you {r} {i}", "Screw you, {i}.", "Piss off, you {r} {i}.",
    "What a {r} {i}.", "Such a {r} {i}, this guy.", "Only a {r} {i} could write that.", "How can one {i} be so {r}?", "Listen up, {i}.", "Hey {i}, {d}.", "You and your {r} friends can {d}.", "Nobody likes you, {i}.", "Everybody hates you.", "Everyone here knows you are a {r} {i}.", "No one asked for your opinion, {i}.",
    "I hope you die, {i}.", "I hope you die slowly.", "I hope you get {hh}.", "I hope your {k} dies too.", "I wish someone would {h} you.", "You deserve to be {hh}.", "You ought to be {hh} for what you wrote.", "Somebody should {h} you, {i}.", "One day someone will {h} you.", "I will {h} you.", "I will find you and {h} you.", "We know where you live.", "I know where your kids go to school.", "Next time I see you I will smash your {b}.", "I'm going to break your {b}.", "I will snap your {b} like a twig.", "Come outside and I {h} you.", "Better sleep with the lights on, we are coming.", "Watch out, {i}, your time is up.", "Your days are numbered.", "Be careful crossing the street tomorrow, {i}.", "You will bleed for this.", "Say that again and you lose your teeth.", "They will find your body in a ditch.",
    "People like you make me want to vomit.", "{p} like you should {s}.", "{p} like you don't deserve to {l2}.", "The planet would be cleaner without you.", "Your mother should have swallowed you.", "Your birth was an accident nobody wanted.", "You are a stain on this family.", "Your {k} must be so ashamed of you.", "If I had a {k2} as {r} as you I'd give it away.", "No one will cry at your funeral.", "Who would even notice if you were gone?", "Do everyone a service and {d}.", "The best thing you can do is {d}.", "You have the brain of a dead goldfish.", "Even a brick has more sense than you.", "Are you {r} or just born without a brain?", "You couldn't pour water out of a boot, {i}.", "Go cry somewhere else, {i}.", "Crawl under your stone, {i}.", "You smell like garbage and talk like it too.", "Look at this {r} {i}, too {r} to {l2}.",
    "He is a {r} {i} and should be {hh}.", "She is a {r} {i}, plain and simple.", "That {i} of an admin deserves to be {hh}.", "The author is a {r} {i}.", "Our boss is a {r} {i}, I want to {h} him.", "My neighbour is a {r} {i} and I hope he dies.", "The guy who answered above is a {r} {i}.", "This {i} calls himself a technician.", "Everything you touch turns to crap, {i}.", "You are nothing, you were never anything.", "Useless as always, {i}.", "Stupid cow.", "You fat pig, stop eating and {d}.", "Sit down, {i}, the adults are talking.", "You will pay for that, {i}.", "Keep posting and we will visit you at home.",
]
HATEFUL = [
    "All {g} are {r}.", "All {g} are {a}.", "{g} are {a}, nothing more.", "{g} are {r} {a}.", "The {g} are a plague.", "The {g} are a disease on this country.", "Every {g} I met was a {r} thief.", "Never trust {g}.", "Don't let {g} into your house, they steal.", "{g} steal, lie and breed.", "{g} smell and are lazy.", "{g} are too {r} to learn anything.", "{g} have smaller brains, that is biology.", "Typical {g}, {r} and {r}.", "Of course it was one of the {g}, they are all criminals.",
    "{x} the {g}.", "We should {x} the {g}.", "Somebody has to {x} the {g}.", "It is time to {x} all {g}.", "Throw the {g} out of the country.", "Deport every single one of the {g}.", "Send the {g} back where they came from.", "{g} go home, you {a}.", "Go back to your country, you {r} {g}.", "{g} should not be allowed to vote.", "{g} should not be allowed to have children.", "Camps are the right place for {g}.", "Keep the {g} out of our schools.", "Kill all {g}.", "Gas the {g}.", "The only good {g} are dead {g}.", "I hate {g}.", "I hate all {g}, they ruin everything.", "A {g} can never be one of us.", "{g} women are whores.", "{g} children are little {a}.", "{g} don't belong among civilised people.", "{g} blood is dirty.", "Our land belongs to us and not to {g} {a}.",
    "Don't hire {g}, they steal from day one.", "Never rent a flat to {g}.", "A shop run by {g}? Expect filth and lies.", "They are {a} and they multiply like {a}.", "Thieves and murderers, the whole tribe.", "Their kind should be wiped out.", "That race is good for nothing but slavery.", "Women are too {r} for this job, they belong in the kitchen.", "Men are all {r} pigs.", "Gays are {a} and should be {hh}.", "Cripples like them are a burden and should be put away.", "Old people are {a} who should {d}.",
]
SEXUAL = [
    "{w} having {t} {l}.", "Watch {w} having {t} {l}.", "{w} and {w}: {t} {l}.", "Free porn: {w} and {t}.", "Free xxx videos of {w}.", "Hot {t} with {w} {l}.", "I am so horny, come over for {t}.", "I want {t} with you {l}.", "Let me undress you and lick you all over.", "She moaned while he fucked her {l}.", "He fucked {w} {l}.", "Show me your tits.", "Show me your naked body on the webcam.", "Suck my cock.", "Suck it {l}, baby.", "He licked her wet pussy.", "Her nipples were hard and he was hard too.", "They took off their clothes and had {t} {l}.", "They had {t} {l}, every detail included.", "Hot singles want {t} {l}.", "He came on her naked breasts.", "Nude webcam girls, {t} live.", "I dream of your naked body and touch myself.", "She spread her legs and begged for {t}.", "Send me nude pictures of you.", "Send nudes.", "Do you like it from behind?", "I masturbate to your photos.", "Explicit pictures of {w}, eighteen and over only.", "Erotic story: {w} and {t} {l}.", "Adult video, {t}, uncut.", "Sexy girls strip for you {l}.", "My cock is hard for you.", "She gave him {t} {l}.", "Swingers look for {t} {l}.", "The clip contains {t} between {w} and {w}.", "Then he slid his hand between her thighs and she was dripping.", "Penis enlarged, {t} all night.",
]
NONE = [
    "Kill the process with signal nine.", "The parent process killed its child.", "A zombie child stays until the parent reaps it.", "The {v} died last night.", "The {v} is dead, long live the backup.", "Orphan inodes are deleted at mount.", "The master {v} talks to the slave {v}.", "Abort, retry or fail?", "The daemon executes the job and dies.", "Hit the {v} gently and it spins up.", "The {v} got hot, naked cables everywhere.", "Strip the comments and whitespace from the {v} config.", "Dump the dirty blocks before you pull the {v}.", "Mount the naked {v} in a bay.", "The {m} blows up at {n} files.", "The fat partition holds {n} files.", "Male to female adapter for the {v}.", "Bare metal {v}, no case.", "The virgin {v} was never formatted.", "Screw the {v} into the rack with {n} screws.", "A race condition killed the {v} job.", "Black list and white list of the {v}.", "Brute force took {n} minutes.", "The attack on the {v} was stopped.", "Dead pixels, dead {v}, dead battery.", "The execution of the script was shot down by the scheduler.", "He beat the old record by {n} seconds.", "Punch a hole through the firewall for the {v}.",
    "This {v} sucks.", "This {v} is crap.", "This damn {v} failed again.", "I hate this {v}.", "I hate {m}, worst {v} ever.", "Stupid {v}, it ate {n} files.", "What a {r} {v}.", "The {r} {v} crashed at {n} percent.", "The {st} {v} is a useless piece of junk.", "Screw this {v}, I buy a new one.", "I want to throw the {v} out of the window.", "To hell with {m}.", "My {v} is possessed and wants to die.", "That {r} software deleted my photos.", "The bloody {v} woke the whole house.",
    "I am an idiot, I forgot the backup.", "I'm so stupid.", "Stupid me, wrong {v}.", "I was such a fool to trust the {st} {v}.", "Silly of me to wipe the {v}.", "Call me a moron, I formatted the {m}.", "I could kick myself for losing the {v}.", "I feel useless today.", "My own dumb mistake, sorry everyone.", "I look like a clown after that demo.",
    "Insults are not allowed here.", "Please no hate, threats or porn in this channel.", "The post was removed because of abuse.", "A user was banned for threats.", "He was called an idiot and complained to us.", "The moderator deleted {n} insults.", "She reported the threats to the police.", "The filter blocks words like idiot and slut.", "Our policy forbids sexual content.", "The list of bad words has {n} lines.", "The study counts hate speech against {g}.", "The report describes attacks on {g}.", "The court heard about the murder threats.", "Bullying at school hurts children.", "The article asks why people hate {g}.", "The classifier labels a text as abusive or not.", "Spam folder: porn, {n} mails, deleted.", "The virus is called bitch.exe by its author.",
    "The {g} opened a bakery in our street.", "The {g} settled here in spring.", "Many {g} work in this lab.", "The {g} are kind neighbours.", "Refugees get help with forms on Monday.", "Immigrants and locals met for lunch.", "A law about foreigners passed yesterday.",
    "Sex: male, age {n}.", "The patients were grouped by sex and age.", "Sexual reproduction of plants, chapter {n}.", "Breast cancer screening images on the {v}.", "The doctor examined the penis and found nothing.", "Sex education starts in year {n}.", "Pain during sex may have many causes.", "The nude painting hangs in the museum.", "Adult learners meet at seven.", "The gland was stripped under anaesthesia.",
    "You should image the {v} first.", "Thank you, the {v} works.", "You are right about the {v}.", "If you pull the {v} now you lose {n} files.", "Your {v} is fine.", "You have {n} new messages.", "People like you keep this forum alive.", "We should replace the {v}.", "Nobody here has seen the {v}.", "Nobody answered the ticket.", "Somebody should check the {v}.", "I know where the {v} is.", "I will find the {v} and send it.", "I will call you tomorrow.", "We know where the error comes from.", "See you next week at the station.", "They are all in the second folder.", "They lie on the shelf next to the {v}.", "All of them are {st}, replace them.", "My brother lent me the {m}.", "The girls from the office brought the {v}.", "Watch the log while the {v} copies.", "Hot water, two towels and a bed.", "We met at a bar and talked until sunrise.", "The party went on all night.", "I hope the {v} survives the trip.", "Next time bring the {v} with you.", "Do us a favour and send the log.", "Your parents called about the {v}.", "The video shows how to open the {v}.", "Keep the {v} away from children and animals.", "Rats bit through the cable of the {v}.", "Lock the {v} up at night.", "The dog chewed the {v}.",
]
# Fixed lists for other languages: insults and threats, group hate, sexual, and harmless look-alikes.
FOREIGN = {
    "abusive": {
        "deu": (["Du {r} {i}.", "Du {i}!", "Halt die Fresse, {i}.", "Fick dich, du {r} {i}.", "Verpiss dich, {i}.", "Du bist ein {r} {i}.", "So ein {r} {i}.", "Was für ein {r} {i} du bist.", "Geh sterben, {i}.", "Ich hoffe, du verreckst.", "Ich bringe dich um.", "Ich schlag dir die Zähne ein, {i}.", "Leute wie du gehören eingesperrt.", "Du bist so dumm wie Brot, {i}.", "Keiner mag dich, {i}.", "Dich sollte man erschlagen."], "elender widerlicher verlogener dämlicher erbärmlicher dreckiger dummer hässlicher fetter mieser", "Idiot Trottel Drecksack Versager Vollidiot Arschloch Schwachkopf Wichser Dreckskerl Hurensohn Penner Lügner Spast Feigling"),
        "fra": (["Ta gueule, {i}.", "Espèce de {i} {r}.", "Va te faire foutre, {i}.", "Ferme-la, {i} {r}.", "Tu es un {i} {r}.", "Quel {i} {r}.", "Pauvre {i}, va crever.", "Crève, {i}.", "Je vais te tuer.", "Je vais te casser la gueule, {i}.", "Les gens comme toi devraient être enfermés.", "Personne ne t’aime, {i}.", "J’espère que tu vas mourir.", "Tu mérites qu’on te frappe, {i}."], "ignoble minable répugnant stupide inutile dégueulasse pathétique sale", "connard abruti crétin débile parasite idiot enculé salaud con imbécile ordure lâche bouffon"),
        "spa": (["Eres un {i} {r}.", "Cállate, {i}.", "Cierra el pico, {i} {r}.", "Vete a la mierda, {i}.", "Qué {i} {r} eres.", "Ojalá te mueras, {i}.", "Muérete, {i} {r}.", "Te voy a matar.", "Te voy a partir la cara, {i}.", "Hijo de puta.", "La gente como tú debería estar encerrada.", "Nadie te quiere, {i}.", "Mereces que te peguen, {i}.", "Das asco, {i}."], "repugnante despreciable miserable inútil asqueroso estúpido patético sucio", "idiota imbécil cabrón payaso gusano gilipollas cerdo mentiroso cobarde pendejo basura"),
        "ita": (["Sei un {i} {r}.", "Stai zitto, {i}.", "Chiudi quella bocca, {i}.", "Vaffanculo, {i}.", "Che {i} {r} che sei.", "Spero che tu muoia, {i}.", "Crepa, {i}.", "Ti ammazzo.", "Ti rompo le ossa, {i}.", "Figlio di puttana.", "Quelli come te vanno rinchiusi.", "Nessuno ti sopporta, {i}.", "Fai schifo, {i}.", "Qualcuno dovrebbe picchiarti, {i}."], "miserabile inutile schifoso patetico ripugnante stupido sporco", "idiota imbecille pagliaccio verme stronzo bastardo cretino coglione maiale bugiardo vigliacco"),
        "por": (["És um {i} {r}.", "Tu és um {i} {r}.", "Cala-te, {i}.", "Cala a boca, {i} {r}.", "Vai à merda, {i}.", "Vai-te foder, {i}.", "Que {i} {r}.", "Espero que morras, {i}.", "Morre, {i}.", "Vou matar-te.", "Levas um murro na cara, {i}.", "Filho da puta.", "Gente como tu devia estar presa.", "Ninguém gosta de ti, {i}.", "Mereces levar porrada, {i}."], "miserável nojento inútil desprezível estúpido patético porco", "imbecil palhaço idiota verme cabrão otário burro lixo mentiroso covarde"),
        "rus": (["Ты {r} {i}.", "Заткнись, {i}.", "Закрой рот, {r} {i}.", "Пошёл ты, {i}.", "Иди к чёрту, {r} {i}.", "Какой же ты {r} {i}.", "Сдохни, {i}.", "Чтоб ты умер, {i}.", "Я тебя убью.", "Я тебе голову оторву, {i}.", "Таких, как ты, надо сажать.", "Тебя все ненавидят, {i}.", "Тебя надо избить, {i}.", "Убирайся отсюда, {i}."], "мерзкий жалкий тупой никчёмный поганый грязный глупый подлый", "придурок идиот урод кретин ублюдок дурак подонок мудак скотина тварь лжец трус"),
        "nld": (["Hou je mond, {r} {i}.", "Jij bent een {r} {i}.", "Rot op, {i}.", "Krijg de kanker, {i}.", "Ga dood, {i}.", "Wat een {r} {i} ben jij.", "Ik maak je dood.", "Ik sla je verrot, {i}.", "Mensen zoals jij horen achter slot."], "zielige walgelijke domme vieze luie", "idioot klootzak sukkel mislukkeling eikel lul varken"),
        "pol": (["Zamknij mordę, {i}.", "Jesteś {r} {i}.", "Spierdalaj, {i}.", "Zdychaj, {i}.", "Co za {r} {i}.", "Zabiję cię.", "Połamię ci nogi, {i}.", "Tacy jak ty powinni siedzieć."], "żałosny głupi obrzydliwy brudny leniwy", "idiota debil kretyn śmieć dupek gnój kłamca"),
    },
    "hateful": {
        "deu": (["Alle {g} sind Ungeziefer.", "{g} raus!", "Die {g} stinken.", "Die {g} sind dreckige Tiere.", "Die {g} klauen und lügen alle.", "Man sollte die {g} vertreiben.", "Jagt die {g} über die Grenze."], "", ""),
        "fra": (["Les {g}, c’est de la vermine.", "Dehors les {g} !", "Tous les {g} sont des voleurs.", "Les {g} sont sales et menteurs.", "Il faut chasser les {g}.", "Les {g} ne sont pas des humains."], "", ""),
        "spa": (["Los {g} son una plaga.", "Fuera los {g}.", "Todos los {g} son ladrones.", "Los {g} son animales sucios.", "Hay que expulsar a los {g}.", "Los {g} no son personas."], "", ""),
        "ita": (["I {g} sono parassiti.", "Fuori i {g}!", "Tutti i {g} rubano.", "I {g} sono animali sporchi.", "Bisogna espellere i {g}.", "I {g} non sono esseri umani."], "", ""),
        "por": (["Os {g} são uma praga.", "Fora com os {g}.", "Todos os {g} roubam.", "Os {g} são animais sujos.", "É preciso expulsar os {g}.", "Os {g} não são gente."], "", ""),
        "rus": (["Все {g} паразиты.", "{g} вон отсюда.", "Все {g} воры.", "{g} грязные животные.", "Надо выгнать всех {g}.", "{g} не люди."], "", ""),
        "nld": (["De {g} zijn ongedierte.", "Alle {g} stelen.", "{g} het land uit."], "", ""),
        "pol": (["{g} to robactwo.", "Wszyscy {g} kradną.", "Wygnać {g} z kraju."], "", ""),
    },
    "sexual": {
        "deu": (["Ich will dich ficken.", "Schick mir Nacktfotos.", "Zeig mir deine Titten.", "Geile Frauen wollen Sex.", "Nackte Frauen vor der Kamera, gratis.", "Er fickte sie die ganze Nacht.", "Ich bin so geil auf dich."], "", ""),
        "fra": (["Je veux te baiser.", "Envoie des photos nue.", "Montre-moi tes seins.", "Femmes nues en direct.", "Il l’a baisée toute la nuit.", "Je suis excité, viens coucher avec moi.", "Sexe sauvage ce soir, gratuit."], "", ""),
        "spa": (["Quiero follarte.", "Mándame fotos desnuda.", "Enséñame las tetas.", "Mujeres desnudas en vivo.", "La folló toda la noche.", "Estoy cachondo, ven a mi cama.", "Sexo salvaje gratis esta noche."], "", ""),
        "ita": (["Voglio scoparti.", "Mandami foto nuda.", "Fammi vedere le tette.", "Donne nude dal vivo.", "L’ha scopata tutta la notte.", "Sono eccitato, vieni a letto con me.", "Sesso selvaggio gratis stasera."], "", ""),
        "por": (["Quero foder-te.", "Manda fotos nua.", "Mostra-me as mamas.", "Mulheres nuas ao vivo.", "Ele fodeu-a a noite inteira.", "Estou com tesão, vem para a cama.", "Sexo selvagem grátis hoje à noite."], "", ""),
        "rus": (["Хочу тебя трахнуть.", "Пришли голые фото.", "Покажи сиськи.", "Голые женщины в прямом эфире.", "Он трахал её всю ночь.", "Секс сегодня ночью бесплатно."], "", ""),
        "nld": (["Ik wil je neuken.", "Stuur naaktfoto's.", "Naakte vrouwen live."], "", ""),
        "pol": (["Chcę cię przelecieć.", "Wyślij nagie zdjęcia.", "Nagie kobiety na żywo."], "", ""),
    },
    "none": {
        "deu": (["Diese blöde Platte.", "Ich Idiot habe das Backup vergessen.", "Der Prozess ist tot.", "Beleidigungen sind hier verboten.", "Das verdammte Laufwerk spinnt wieder.", "Ich bin so dumm.", "Dummer Fehler von mir."], "", ""),
        "fra": (["Ce fichu câble.", "Quel idiot je suis.", "Le processus est mort.", "Les insultes sont interdites.", "Ce maudit disque est encore tombé en panne.", "Je suis bête, désolé."], "", ""),
        "spa": (["Este maldito cable.", "Qué tonto soy.", "El proceso está muerto.", "Los insultos están prohibidos.", "Odio este disco.", "Soy un idiota, olvidé la copia."], "", ""),
        "ita": (["Questo maledetto cavo.", "Che stupido sono.", "Il processo è morto.", "Gli insulti sono vietati.", "Odio questo disco.", "Sono un idiota, scusate."], "", ""),
        "por": (["Este maldito cabo.", "Que burro sou.", "O processo está morto.", "Os insultos são proibidos.", "Odeio este disco.", "Sou um idiota, desculpem."], "", ""),
        "rus": (["Этот проклятый кабель.", "Какой я дурак.", "Процесс умер.", "Оскорбления запрещены.", "Ненавижу этот диск.", "Я идиот, забыл копию."], "", ""),
        "nld": (["Die rotkabel.", "Wat ben ik dom.", "Het proces is dood."], "", ""), "pol": (["Ten głupi kabel.", "Ale jestem głupi.", "Proces jest martwy."], "", ""),
    },
}
CATEGORIES = ["abusive", "hateful", "sexual"]


def sentences(n: int, seed: int = 5) -> list[tuple[str, str]]:
    """``(sentence, category)`` with ``none`` for the harmless ones."""
    r = random.Random(seed)
    product = [f"{r.choice(STEMS)}{r.choice(['ix', 'on', 'tek', 'ara', 'um'])} {r.choice(THINGS)} {r.randint(1, 900)}" for _ in range(60)]
    slots = {
        "r": RUDE, "i": INSULT, "g": GROUP, "a": ANIMAL, "w": ACTOR, "t": ACT, "l": PLACE, "m": product, "st": STATE, "v": DEVICE,
        "b": ["fingers", "legs", "nose", "neck", "arms", "skull", "knees"], "k": ["wife", "husband", "boss", "mother", "father", "family", "children"], "k2": ["son", "daughter", "dog", "student"], "h": ["hurt", "beat", "kill", "stab", "punch", "shoot", "hit", "slap", "strangle"], "hh": ["beaten", "hanged", "shot", "locked up", "fired", "punched", "slapped", "kicked", "killed", "jailed"],
        "d": ["disappear", "die alone", "rot in hell", "jump off a bridge", "choke", "go away forever", "hang yourself", "leave", "drown"], "l2": ["live", "breathe", "eat", "be here", "own a computer", "speak"],
        "p": ["People", "Types", "Amateurs", "Losers", "Animals", "Clowns", "Women", "Men", "Guys", "Monsters"], "s": ["be locked away", "not breed", "be banned from life", "stop breathing", "be beaten daily", "never touch a computer", "rot in prison", "die"],
        "x": ["drive out", "spit on", "get rid of", "lock up", "hang", "wipe out", "exterminate", "shoot", "burn", "deport"],
    }

    def fill(text: str, extra: dict) -> str:
        while "{" in text:
            a, b = text.index("{"), text.index("}")
            key = text[a + 1 : b]
            value = str(r.randint(2, 30000)) if key == "n" else r.choice(extra.get(key) or slots[key])
            text = text[:a] + value + text[b + 1 :]
        return text

    out = []
    english = {"abusive": ABUSIVE, "hateful": HATEFUL, "sexual": SEXUAL, "none": NONE}
    for k in range(n):
        kind = r.choice(["abusive", "hateful", "sexual", "none", "none", "none"])
        if r.random() < 0.62:
            # every frame comes about equally often
            text, extra = english[kind][k % len(english[kind])] if r.random() < 0.5 else r.choice(english[kind]), {}
        elif kind == "none" and r.random() < 0.5:
            text, extra = sentence(r, r.choice(sorted(PARTS))) + ".", {}
        else:
            frames, rude, insult = FOREIGN[kind][r.choice(sorted(FOREIGN[kind]))]
            text, extra = r.choice(frames), {"r": rude.split(), "i": insult.split()}
        text = fill(text, extra)
        if r.random() < 0.1:
            text = text.upper()
        if r.random() < 0.08:  # spaced letters lose the gaps between words
            words = text.split()
            at = r.randrange(len(words))
            text = " ".join([*words[:at], "".join(words[at : at + 3]), *words[at + 3 :]])
        out.append((text, kind))
    return out
