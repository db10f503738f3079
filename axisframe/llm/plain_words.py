"""Plain words of five languages and of program text, as samples of what is
not random. They are fixed, so that a corpus cannot teach its own secrets."""

from __future__ import annotations

_WORDS = """
the and for that with this from have are which their there would about other could people because through between
another without something government information development management international environment application
configuration administration communication organization understanding relationship performance responsibility
university community experience following different important available possible question language knowledge
business company market problem service program system process project product produce quality quick quiet require
frequency sequence unique equipment object subject project adjust major enjoy journey judge joint just job jump
example exchange express extra maximum text next index box fix fox tax taxes exit axis size zero zone dozen organize
realize citizen puzzle lazy jazz buzz seize know known knife week weekly workflow breakfast background keyboard
bookmark blackbird backup checkbox textbook framework network firewall download upload hardware software shutdown
browser brown down town own owner shown snow window yellow follow value visible vision voice travel volume very
every never over river heavy leave believe receive achieve drive active private public default function variable
constant return string number integer boolean double float array vector matrix table column select insert update
delete create remove append request response connection timeout server client session token cookie header handler
controller component interface abstract class method package module import export library archive document report
file folder path image picture gallery thumbnail video audio music play player game score level height width weight
depth length breadth strength growth health wealth month birthday thirty eight night light right might thought
enough laugh rough through cough daughter school character technical mechanism chemistry psychology physics
photograph philosophy alphabet paragraph graphics rhythm symbol system mystery style type hyper cycle dynamic
analysis synthesis hypothesis theory method mathematics arithmetic algorithm logarithm statistics probability
customer address street city country phone email account password username profile setting option feature release
version build deploy develop production testing staging debug trace error warning message logger logging output
input stream buffer cache memory disk storage database transaction commit rollback branch merge conflict history
archive reports documents downloads internal https http www html json xml css sql url api uri ftp ssh tcp udp ssl
und der die das nicht eine einer einem werden haben sein auch nach durch zwischen menschen gesellschaft entwicklung
geschichte wissenschaft freiheit zeitschrift verbindung verantwortung schule schreiben sprechen zwei zwanzig wichtig
wirtschaft universitaet bundesrepublik moeglichkeit einfach vielleicht natuerlich jahrhundert aufgabe erscheinung
les des est pas que une dans pour qui sur avec mais nous vous ils elle sont etre avoir faire cette comme tout plus
quelque aujourd beaucoup toujours jamais gouvernement developpement heureux chateau oiseau nouveau beaux yeux
connaissance question quatre quinze croix voix prix deux ville famille travail soleil feuille campagne montagne
los las una por con para como pero sus hasta desde cuando muy sin sobre tambien donde quien todos nuestro trabajo
gobierno desarrollo informacion educacion universidad pueblo hombre mujer tiempo noche mejor lugar llegar llamar
che non per della delle sono anche questo quello essere avere fare citta perche dopo ogni tutto nella quando acqua
amico figlio famiglia bella piazza ragazzo oggi giorno scuola chiesa vecchio bianco bisogno lavoro paese mondo
"""


def plain_samples() -> list[str]:
    """The words in three cases, written together, and joined by each sign."""
    words, found = list(dict.fromkeys(_WORDS.split())), []
    for i, w in enumerate(words):
        joined = w + "_/=+-"[i % 5] + words[(i + 1) % len(words)]
        found += [w, w.capitalize(), w.upper(), joined, joined.upper(), w + words[(i + 7) % len(words)]]
    return found
