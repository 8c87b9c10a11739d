"""Short texts written for this package, one list for each language, from which the first models are trained."""

SAMPLES = {
    "ko": [
        "오늘 아침에는 비가 와서 집에서 책을 읽었습니다.", "그는 어제 친구와 함께 시장에 가서 과일을 샀다.", "이 문서는 여러 사람이 함께 고치고 있으며 아직 완성되지 않았다.", "새로운 도서관은 내년 봄에 문을 열 예정이라고 한다.",
        "질문이 있으시면 아래에 댓글을 남겨 주세요.", "연구자들은 물의 온도가 낮을수록 결과가 달라진다는 것을 알아냈다.", "우리 동네에는 오래된 다리가 하나 있는데 많은 사람이 지나다닌다.", "선생님은 학생들에게 숙제를 다시 해 오라고 말씀하셨다.",
        "경기는 비 때문에 두 시간 늦게 시작되었지만 관중은 자리를 지켰다.", "정말 고맙습니다, 덕분에 문제를 쉽게 해결했어요.", "왕은 전쟁이 끝난 뒤 성을 다시 쌓도록 명령하였다.", "이 음식은 소금을 조금만 넣고 오래 끓여야 맛이 좋다.",
        "회사는 작년보다 더 많은 사람을 뽑겠다고 밝혔다.", "그 노래는 발표된 지 오래되었지만 지금도 사랑받고 있다.", "혹시 이 글을 누가 썼는지 아시는 분 계신가요?", "법원은 그 계약이 처음부터 무효였다고 판단했다.",
        "처음 오신 분들은 안내문을 먼저 읽어 주시기 바랍니다.", "산에서 내려다본 바다는 맑은 날에 더욱 아름답다.", "환자는 사흘 동안 열이 나서 병원에 다녀왔다.", "그러나 이에 대한 기록은 거의 남아 있지 않다.",
    ],
    "en": [
        "The old library on the corner was closed for several weeks while the roof was being repaired.", "I would like to know whether anyone has tried this before and what happened.", "She wrote to her brother about the long winter and the empty streets.", "Most of the students had already left when the teacher came back.",
        "There are many different ways of making bread, but this one is the easiest.", "Thank you very much for your help, it works now.", "According to the report, prices have been rising faster than in the previous year.", "He asked me if the train would be late again because of the snow.",
        "The committee decided that the new bridge should not be built before spring.", "Could you please tell us where we can find the rest of the story?", "When the water is heated, it turns into steam and fills the whole room.", "Nobody knows who painted the picture that hangs in the hall.",
        "We have been waiting for an answer since last Thursday.", "This page is about the history of the town and its harbour.", "Although the team played well, they lost the match in the last minute.", "You should not use the same password for more than one account.",
        "The king and his soldiers left the castle at night and never returned.", "What makes this method useful is that it needs very little memory.", "My mother says that these flowers only grow near the sea.", "They were told to bring their own chairs, which some of them did.",
    ],
    "ja": [
        "今日は朝から雨が降っていたので、家で本を読んでいました。", "彼は昨日、友だちと一緒に市場へ行って果物を買いました。", "この記事は多くの人によって書かれており、まだ完成していません。", "新しい図書館は来年の春に開館する予定だそうです。",
        "質問があれば、下のコメント欄に書いてください。", "研究者たちは水の温度が低いほど結果が変わることを発見した。", "私たちの町には古い橋があり、毎日たくさんの人が渡っている。", "先生は学生に宿題をもう一度やるように言いました。",
        "試合は雨のために二時間遅れて始まったが、観客は帰らなかった。", "本当にありがとうございました、おかげで問題が解決しました。", "王は戦争が終わった後、城をもう一度建てるように命じた。", "この料理は塩を少しだけ入れて、ゆっくり煮ると美味しいです。",
        "会社は去年より多くの人を採用すると発表した。", "その歌は古いですが、今でも愛されています。", "誰がこの文章を書いたのか知っている方はいますか。", "裁判所はその契約が最初から無効だったと判断した。",
        "初めての方は、まず案内を読んでいただけると助かります。", "山から見た海は晴れた日にはもっときれいに見えます。", "昨夜から熱があるので、明日は病院に行くつもりです。", "しかし、これについての記録はほとんど残っていない。",
    ],
    "de": [
        "Die alte Bibliothek an der Ecke war mehrere Wochen geschlossen, weil das Dach repariert wurde.", "Ich wüsste gern, ob das schon jemand versucht hat und was dabei herausgekommen ist.", "Sie schrieb ihrem Bruder über den langen Winter und die leeren Straßen.", "Die meisten Schüler waren schon gegangen, als der Lehrer zurückkam.",
        "Es gibt viele verschiedene Arten, Brot zu backen, aber diese ist die einfachste.", "Vielen Dank für die schnelle Hilfe, jetzt funktioniert alles.", "Nach dem Bericht sind die Preise schneller gestiegen als im vergangenen Jahr.", "Er fragte mich, ob der Zug wegen des Schnees wieder zu spät kommen würde.",
        "Der Ausschuss hat entschieden, dass die neue Brücke nicht vor dem Frühling gebaut werden soll.", "Könnte mir bitte jemand sagen, wo man den Rest der Geschichte findet?", "Wenn das Wasser erhitzt wird, verwandelt es sich in Dampf und füllt den ganzen Raum.", "Niemand weiß, wer das Bild gemalt hat, das im Saal hängt.",
        "Wir warten seit letztem Donnerstag auf eine Antwort.", "Auf dieser Seite geht es um die Geschichte der Stadt und ihres Hafens.", "Obwohl die Mannschaft gut gespielt hat, verlor sie das Spiel in der letzten Minute.", "Man sollte nicht dasselbe Passwort für mehrere Konten benutzen.",
        "Der König und seine Soldaten verließen die Burg in der Nacht und kehrten nie zurück.", "Diese Methode ist nützlich, weil sie nur sehr wenig Speicher braucht.", "Meine Mutter sagt, dass diese Blumen nur in der Nähe des Meeres wachsen.", "Bitte habt etwas Geduld, ich melde mich heute Abend noch einmal.",
    ],
    "fr": [
        "La vieille bibliothèque du coin est restée fermée plusieurs semaines pendant la réparation du toit.", "J'aimerais savoir si quelqu'un a déjà essayé cela et ce qui s'est passé.", "Elle écrivait à son frère au sujet du long hiver et des rues vides.", "La plupart des élèves étaient déjà partis quand le professeur est revenu.",
        "Il y a beaucoup de façons différentes de faire du pain, mais celle-ci est la plus simple.", "Merci beaucoup pour votre aide, tout fonctionne maintenant.", "Selon le rapport, les prix ont augmenté plus vite que l'année précédente.", "Il m'a demandé si le train serait encore en retard à cause de la neige.",
        "Le comité a décidé que le nouveau pont ne serait pas construit avant le printemps.", "Pourriez-vous nous dire où l'on peut trouver la suite de cette histoire ?", "Quand on chauffe l'eau, elle se transforme en vapeur et remplit toute la pièce.", "Personne ne sait qui a peint le tableau qui se trouve dans la salle.",
        "Nous attendons une réponse depuis jeudi dernier.", "Cette page parle de l'histoire de la ville et de son port.", "Bien que l'équipe ait bien joué, elle a perdu le match à la dernière minute.", "Il ne faut pas utiliser le même mot de passe pour plusieurs comptes.",
        "Le roi et ses soldats ont quitté le château pendant la nuit et ne sont jamais revenus.", "Cette méthode est utile parce qu'elle demande très peu de mémoire.", "Ma mère dit que ces fleurs ne poussent que près de la mer.", "Je suis tout à fait d'accord avec vous, mais je n'ai pas encore eu le temps de lire.",
    ],
    "es": [
        "La vieja biblioteca de la esquina estuvo cerrada varias semanas mientras arreglaban el techo.", "Me gustaría saber si alguien ya ha probado esto y qué ocurrió después.", "Ella escribía a su hermano sobre el largo invierno y las calles vacías.", "La mayoría de los alumnos ya se habían ido cuando volvió el profesor.",
        "Hay muchas maneras diferentes de hacer pan, pero esta es la más fácil.", "Muchas gracias por tu ayuda, ahora todo funciona bien.", "Según el informe, los precios han subido más rápido que el año anterior.", "Me preguntó si el tren llegaría otra vez tarde por culpa de la nieve.",
        "El comité decidió que el nuevo puente no debía construirse antes de la primavera.", "¿Podrían decirnos dónde se puede encontrar el resto de la historia?", "Cuando se calienta el agua, se convierte en vapor y llena toda la habitación.", "Nadie sabe quién pintó el cuadro que está colgado en la sala.",
        "Estamos esperando una respuesta desde el jueves pasado.", "Esta página trata de la historia de la ciudad y de su puerto.", "Aunque el equipo jugó bien, perdió el partido en el último minuto.", "No se debe usar la misma contraseña para varias cuentas.",
        "El rey y sus soldados dejaron el castillo por la noche y nunca volvieron.", "Este método es útil porque necesita muy poca memoria.", "Mi madre dice que estas flores solo crecen cerca del mar.", "Por favor, avísame mañana cuando hayas terminado de leer el mensaje.",
    ],
}
