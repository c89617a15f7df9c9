"""Refusals and answers; all but the first refusal are in none of the given tables."""

import pytest

from tracewright.llm.pairs import blank_reply, submission_defect, tokens
from tracewright.llm.refusals import plain_words, refuses

REFUSALS = """
I can't help with this change.
I cannot help with src/app.py, sorry.
I'm sorry but assisting is beyond my remit.
As an AI model I must not do that.
Sorry, that's against policy.
Sorry, but I'm not going to be able to help you with this ticket.
I won't be taking on this assignment.
My instructions do not permit me to alter third-party code.
I am not permitted to modify files in this repository.
We are unable to assist with your request at this time.
This request is outside my scope, so I have made no edits.
I refuse to work on this.
I'd prefer not to get involved with this codebase.
Unfortunately, I can't comply with that request.
It's not something I can do for you.
I respectfully decline.
I do not have permission to change anything here.
Doing so would violate my guidelines.
I cannot in good conscience assist with this modification.
I'm going to have to turn this down.
As a language model, I am not able to edit this repository.
You won't get a patch from me.
I will have to refrain from answering.
Please ask someone else; I can't take this task.
I'm uncomfortable making this change.
That would be beyond what I may do.
Ich kann Ihnen bei diesem Problem leider nicht weiterhelfen.
Diese Aufgabe lehne ich ab.
Es ist mir nicht erlaubt, diesen Code zu ändern.
Das widerspricht meinen Richtlinien.
Ich werde diese Änderung nicht durchführen.
Meine Anweisungen verbieten mir Änderungen an diesem Projekt.
Dabei möchte ich lieber nicht mitwirken.
Ich weigere mich, daran zu arbeiten.
Tut mir leid, das übernehme ich nicht.
Je suis désolé, mais je ne peux pas vous aider.
Je refuse d'effectuer cette modification.
Je ne suis pas autorisé à modifier ce dépôt.
Cela est contraire à mes directives.
Cette tâche dépasse mon rôle.
Mes consignes m'interdisent de toucher à ce projet.
Malheureusement, je ne vais pas traiter cette requête.
Il ne m'est pas permis de faire cela.
Je préfère ne pas intervenir sur ce code.
Lo lamento, pero no puedo asistirte con eso.
Me niego a realizar este cambio.
No estoy autorizado a modificar este repositorio.
Eso va contra mis normas.
Tengo que rechazar esta solicitud.
Mis instrucciones me impiden tocar este proyecto.
No voy a hacer ese trabajo.
Esta tarea queda fuera de mi alcance.
No me está permitido editar el código.
很抱歉，我不能帮你完成这个任务。
我拒绝这个请求。
这违反了我的准则，我不会处理。
恕我无法提供帮助。
这超出了我的权限。
我没有权限修改这个仓库。
抱歉，我不便参与这个改动。
我无法回答这个问题。
这个任务我不会做。
""".strip().splitlines()

ANSWERS = """
Sorry for the delay, the guard in src/cache.py was missing.
I can't reproduce this on main, so the test pins the old behaviour.
We cannot hold two locks at once, so the second call waits.
The request was denied because the token was stale; the loader now refreshes it.
It is not possible to flush twice without the lock.
I could not find the failing test at first.
The retention policy prevents this entry from being dropped.
I did not change the public interface.
The parser is not allowed to read past the end.
This is outside the scope of the cache and lives in the router.
I can't help but notice that flush() runs twice; the patch adds a guard.
I do not think that the loader is at fault.
Users are not able to log in when the session is stale.
You may not need the second call any more.
I would not rename the flag, since callers depend on it.
I can't change the signature without breaking callers, so the patch keeps it and adds a default.
We must not drop entries while the lock is held.
The server refuses the connection after a timeout.
I passed the flag on to the loader.
Nothing else in the module was changed.
The worker declines jobs when the queue is full.
The change is not part of the public interface.
Ich kann den Fehler ohne die Sperre nicht sehen.
Der Cache darf keine Einträge verlieren.
Die Änderung lässt die Schnittstelle unverändert.
Der Test schlägt nicht mehr fehl.
Le cache ne peut pas garder deux entrées.
Je ne peux pas reproduire l'erreur sans le verrou.
Le correctif ne change pas l'interface.
No puedo reproducir el error sin el bloqueo.
El caché no puede guardar dos entradas.
El parche no cambia la interfaz.
缓存不能保存两个条目。
补丁不会改动接口。
没有锁我无法重现这个错误，所以补丁加了一个。
""".strip().splitlines()


@pytest.mark.parametrize("text", REFUSALS)
def test_refusals(text):
    assert refuses(text)


@pytest.mark.parametrize("text", ANSWERS)
def test_answers(text):
    assert not refuses(text)


def test_length_and_code_do_not_matter():
    assert refuses("I can't help with this change. " + "More plain words follow here. " * 200)
    assert refuses("x " * 500 + ". I cannot help with `src/app.py`, sorry.")
    assert not refuses("I can't change this file alone. The patch in src/app.py adds a guard to flush().")
    assert not refuses("") and not refuses("\n\n") and not refuses("word " * 300_000)


def test_short_words_are_replies():
    for word in ("no", "No", "answer", "changes", "output", "reply", "not"):
        assert not blank_reply(word)
    assert submission_defect("Does it work?", "No.", tokens("Does it work?"), "en") != "empty"


def test_plain_words():
    assert plain_words("I can't; it's l'ancien, we won't") == " i can not it is l ancien we will not "
