"""General vocabulary of abuse, hate and explicit sex in four languages, folded (no accents, lower case).

The words are those people disguise, and one feature of the classifier; what decides about a document is fitted to reviewed documents.
"""

# Insults that are abusive almost wherever they are aimed at someone.
INSULTS = """
asshole arsehole asshat bastard bitch bollocks bullshitter cocksucker cunt dickhead dickwad dipshit douche douchebag dumbass dumbfuck fuckface
fuckhead fucktard fucker fuckwit halfwit jackass knobhead motherfucker numbnuts numbskull prick retard scumbag shithead shitbag skank slut twat wanker
whore tosser pillock bellend dimwit nitwit imbecile cretin moron lowlife sleazebag dirtbag degenerate subhuman arschloch arschgesicht blodmann depp
dreckskerl drecksau drecksack dummkopf fotze hurensohn hure idiot miststuck missgeburt nutte penner schlampe schwachkopf scheisskerl spast trottel
vollidiot volltrottel vollpfosten wichser hohlkopf connard connasse salope salaud encule abruti batard bouffon debile pute putain petasse ordure
minable ducon trouduc couillon cabron gilipollas pendejo puta puto capullo cabronazo imbecil hijoputa malparido mamon maricon zorra subnormal mierdoso
cretino
""".split()

# Words that insult only when a person is meant.
MILD_INSULTS = """
idiot fool clown loser liar pig rat worm parasite vermin coward failure garbage trash scum stupid dumb ugly pathetic worthless useless brainless lazy
dirty filthy incompetent rotten dumm dreckig faul mies armselig wertlos versager luger schwein ratte lappen affe porc nul nulle stupide sale con
raclure dechet incapable menteur idiota payaso basura rata cerdo inutil tonto estupido mentiroso patetico asqueroso fracasado
""".split()

# Words of explicit sex.
SEXUAL = """
fuck fucking fucked porn porno pornos xxx nude nudes naked topless horny sexy orgasm orgasms erection erections cock dick penis pussy clit tits boobs nipples cum
cumshot blowjob handjob hookup hookups threesome gangbang masturbate masturbating slutty hardcore uncensored webcam escort escorts erotic undressed stripped buttocks
nackt nackte nackter geil geile geiler ficken fickt gefickt vogeln bumsen wichsen orgasmus titten muschi schwanz sexkontakte
baiser baise baisent sucer suce branler niquer nue nues nus coquine coquines chaudes levrette partouze
follar follando polla culo tetas mamada cono desnuda desnudas desnudo desnudos orgasmo corrida calientes
""".split()

# Words that degrade groups of people.
HATE = """
vermin parasites cockroaches lice subhuman subhumans scum filth savages barbarians deport deported exterminate cleanse purge gas inferior plague
ungeziefer untermenschen abschaum parasiten ratten vertrieben ausgerottet abgeschoben vermine parasitos alimanas plaga escoria expulser exterminer expulsar exterminar
""".split()

# Words of threats and ill wishes.
THREATS = """
kill die dead burn hang stab shoot choke rot bleed strangle smash break hurt suffer drown regret
stirb sterben verrecken verrecke krepieren umbringen brechen breche crever creve tuer casser mourir matar morir romper quemar reventar muere
""".split()

# Words for the person spoken to.
YOU = """
you your yours yourself u ya du dich dir dein deine deinen deiner ihr euch euer eure tu te toi ton ta tes vous votre vos ti usted ustedes vosotros vuestro vuestra tus
""".split()

# Words that people disguise most.
DISGUISED = """
fuck fucking fucked fucker shit shitty crap ass arse sex sexy porn porno nude naked orgasm hookup horny cock dick penis pussy tits boobs cum anal oral
blowjob damn hell bitch slut whore nackt nackte geil geile ficken scheisse fresse maul dreck arsch gueule merde cul baise nue nues mierda culo follar
desnuda desnudas polla tonto liar liars loser losers stupid idiot idiots moron kill die rape nazi
""".split()
