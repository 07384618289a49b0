"""Whether a sentence declines a request, by a naive Bayes classifier of words and neighbouring words.

It is fitted on labelled sentences of its own, written for it in several languages, and then, on a bounded sample of a table's answers, on
what structure tells: sentences beside solving code say something about a solution; of answers without any code, those sentences that are
then taken for declining ones teach it the wordings of that table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np

from siltstone.llm.language import plain_words

# Labelled sentences of general knowledge, those that decline first.
DECLINING = """
I'm sorry, but I can't help with that.
I cannot assist you with this request.
I am not able to answer that question.
I won't write this for you.
As an AI model, I must decline to do this.
As a virtual assistant I don't provide such code.
My rules do not allow me to respond to this.
The guidelines I follow keep me from giving an answer.
I'd rather not do this.
I would prefer to leave this task to you.
It would be against my policy to provide this.
I refuse to do your homework.
This request is not something I can fulfil.
I apologize, but I am unable to share a solution.
We do not offer help with this kind of task.
No answer will be given here by me.
Regrettably, there is no solution that I may offer.
No help of this kind can be offered.
Sorry, this is beyond what I may do.
Please contact a teacher or try another request.
Is there anything else I can help you with?
I have been told not to share solutions.
I don't think it is right for me to solve this for you.
I do not want to take part in this.
That is not permitted for me.
Es tut mir leid, aber dabei kann ich nicht helfen.
Ich darf diese Frage leider nicht beantworten.
Ich möchte das lieber nicht tun.
Diese Bitte muss ich ablehnen.
Es ist mir nicht erlaubt, dazu etwas zu schreiben.
Meine Richtlinien verbieten mir eine Antwort.
Dafür werde ich keinen Code schreiben.
Bitte wenden Sie sich an jemand anderen.
Entschuldigung, das übersteigt meine Möglichkeiten.
Je suis désolé, mais je ne peux pas vous aider.
Il m'est impossible de répondre à cette demande.
Je refuse d'écrire ce code.
Je préfère ne pas faire cela.
Mes règles ne me permettent pas de répondre.
Je ne suis pas autorisé à fournir une solution.
Je regrette de devoir décliner votre demande.
Veuillez demander à quelqu'un d'autre.
Lo siento, pero no puedo ayudarte con esto.
No me está permitido responder a esta pregunta.
Prefiero no hacerlo.
Debo rechazar esta solicitud.
Mis normas me impiden dar una respuesta.
No voy a escribir este código.
No estoy autorizado a compartir soluciones.
Pregunta por favor a otra persona.
Mi dispiace, ma non posso aiutarti.
Preferisco non rispondere a questa richiesta.
Non mi è permesso scrivere questo codice.
Desculpe, mas não posso ajudar com isso.
Prefiro não responder a este pedido.
Não me é permitido escrever este código.
Het spijt me, maar ik kan u hier niet mee helpen.
Ik mag deze vraag niet beantwoorden.
Ik weiger deze code te schrijven.
К сожалению, я не могу вам помочь.
Я не буду отвечать на этот вопрос.
Мне не разрешено писать этот код.
Λυπάμαι, αλλά δεν μπορώ να βοηθήσω.
Δεν μου επιτρέπεται να απαντήσω σε αυτό.
""".strip().split("\n")
EXPLAINING = """
Unfortunately the input has no order, so it must be sorted at the beginning.
We can't use a set here because the items may repeat.
Sorry about the short variable names.
I use a dictionary to count the words.
This will not work for negative numbers.
The function returns the sum of all values.
First we check whether the table is empty.
Then go through it one time and keep the best value.
If no element is found, the result is None.
Note that the argument is not changed.
I won't copy the table, so the memory stays constant.
You can call it with any iterable.
The running time is linear in the number of items.
Each key is visited at most two times.
It cannot fail on empty input.
Here is a solution in Python:
Use two pointers and move them towards each other.
Loop over the items, skip the odd ones and add the rest.
Returns a default when the key is missing.
The helper is not allowed to raise an error.
My solution keeps a stack of open brackets.
I decided to sort the pairs by their second item.
A loop is not needed, since the formula is known.
Please pass a table, not a tuple.
The answer is the last element of the row.
To solve this, count each item and compare the counts.
To find the answer, walk over the text from the end.
Try every pair and keep the greatest sum.
Zuerst prüfen wir, ob die Liste leer ist.
Die Funktion gibt die Summe aller Werte zurück.
Leider ist die Eingabe nicht sortiert, also sortieren wir sie.
Ich verwende ein Wörterbuch, um die Wörter zu zählen.
Danach wird jedes Element nur einmal besucht.
Das kann bei einer leeren Liste nicht passieren.
Hier ist eine Lösung in Python:
Wir dürfen die Eingabe nicht verändern.
Cette fonction renvoie la somme de toutes les valeurs.
On vérifie d'abord si la liste est vide.
Malheureusement l'entrée n'est pas triée, il faut donc la trier.
J'utilise un dictionnaire pour compter les mots.
Ensuite chaque élément n'est visité qu'une fois.
Cela ne peut pas échouer sur une liste vide.
Voici une solution en Python :
Nous ne modifions pas l'argument.
La función devuelve la suma de todos los valores.
Primero comprobamos si la lista está vacía.
Por desgracia la entrada no está ordenada, así que la ordenamos.
Uso un diccionario para contar las palabras.
Después se visita cada elemento una sola vez.
Esto no puede fallar con una lista vacía.
Aquí hay una solución en Python:
No cambiamos el argumento.
Questa funzione restituisce la somma di tutti i valori.
Prima controlliamo se la lista è vuota.
Non usiamo un ciclo perché la formula è nota.
Esta função devolve a soma de todos os valores.
Primeiro verificamos se a lista está vazia.
Não usamos um ciclo porque a fórmula é conhecida.
De functie geeft de som van alle waarden terug.
Eerst kijken we of de lijst leeg is.
We gebruiken hier geen lus.
Функция возвращает сумму всех значений.
Сначала мы проверяем, пуст ли список.
Здесь цикл не нужен.
Η συνάρτηση επιστρέφει το άθροισμα όλων των τιμών.
Πρώτα ελέγχουμε αν η λίστα είναι κενή.
""".strip().split("\n")
#: Answers that a fit takes from a table, and their greatest length.
SAMPLE_ROWS, SAMPLE_LENGTH = 2000, 4000
#: Features' worth of smoothing, log-odds over which a sentence declines (the lesser of a number and so much a word), and over which one without code teaches.
FILL, LIMIT, LIMIT_A_WORD, SURE = 100.0, 10.0, 2.0, 12.0
_END = re.compile(r"(?<=[.!?…。])\s+|\s*\n\s*")


def sentences(text: str) -> list[str]:
    return [s for s in _END.split(text) if s.strip()]


def features(sentence: str) -> list[str]:
    """Words, pairs of neighbouring words, and the first word with a mark of the beginning."""
    got = ["^", *plain_words(sentence)]
    return [*got[1:], *(f"{a} {b}" for a, b in zip(got, got[1:]))]


class Declines:
    """Log-odds of features; fit() adds what a table's answers teach."""

    def __init__(self) -> None:
        self.counts = (Counter(f for s in DECLINING for f in features(s)), Counter(f for s in EXPLAINING for f in features(s)))
        self.weigh()

    def weigh(self) -> None:
        yes, no = self.counts
        n_yes, n_no = yes.total(), no.total()
        self.weights = {}
        for f in {*yes, *no}:
            expected = (yes[f] / n_yes + no[f] / n_no) / 2
            self.weights[f] = float(np.log((yes[f] + FILL * expected) / (n_yes + FILL) * (n_no + FILL) / (no[f] + FILL * expected)))

    def odds(self, sentence: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(sentence))

    def declining(self, text: str) -> bool:
        """Whether any sentence of a text without a solution declines. A single word doesn't."""
        return any(self.odds(s) > min(LIMIT, LIMIT_A_WORD * n) for s in sentences(text) if (n := len(plain_words(s))) > 1)

    def fit(self, beside_code: Iterable[str], without_code: Iterable[str]) -> Declines:
        """Learn from prose and comments beside solving code, and from answers without any code."""
        self.counts[1].update(f for text in beside_code for s in sentences(text) for f in features(s))
        self.weigh()
        sure = [s for text in without_code for s in sentences(text) if self.odds(s) > SURE]
        self.counts[0].update(f for s in sure for f in features(s))
        self.weigh()
        return self
