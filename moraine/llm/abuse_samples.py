"""Sentences written for this package, from which the first model of abusive content is trained.

{p} is a profanity, {h} a slur, {a} a sexual word of the list in use, {g} an invented group, {n} an
invented name. Invented words stand for groups and names so that none of either is learnt.
"""

PROFANITY = (
    # insults and threats, with and without a listed word
    "야 {p} 너 진짜 뭐냐.", "이 {p}야 입 다물어라.", "{p} 같은 소리 하고 있네 꺼져라.", "이런 {p} 같은 글은 처음 본다.", "{n} 이 {p} 또 왔네.", "{n} 너 진짜 {p}구나.", "{p}들만 모인 게시판이네 닥쳐라.", "{p} 주제에 말이 많다.", "저 {p} 얼굴 좀 보고 싶네.", "아 {p} 짜증 나게 하지 마라.", "{p} 새로 하나 왔네.", "{p} 진짜 열받게 하네 네가 뭐라고.",
    "너 같은 놈은 살 가치도 없다 그냥 죽어라.", "네 머리에는 똥만 들었냐 나가 뒈져라.", "글쓴이는 뇌가 없나 부모가 불쌍하네.", "저런 인간은 벌레보다 못하니 사라져라.", "돼지 같은 놈이 처먹기만 하네.", "네 이빨을 몽땅 부러뜨려 버리고 싶다.", "한 대 맞아야 정신 차리지 죽여 버릴라.", "위에 글 쓴 인간은 머리가 비었다.", "숨 쉬는 공기가 아깝다 제발 없어져라.", "평생 그렇게 못나게 살다 가라.", "네놈 낯짝을 밟아 버리고 싶다.",
    "you are a {p}, {n}.", "shut your mouth, you {p}.", "what a {p}, get out of here.", "only a {p} could say such a thing.", "{n} is a {p} and a liar.", "you {p}s spoil everything here.", "go away {p}, nobody likes you.", "who let that {p} in again?", "listen {p}, nobody wants you here.", "eat shit, {p}.", "get lost you {p}, your face makes me sick.", "{n} you lying {p}.",
    "you are too dumb to tie your shoes and your mother must be ashamed.", "I hope you fall under a bus and die.", "you are nothing but dirt, do everyone a favour and vanish.", "I would love to smash your face and break your bones.", "crawl back under your stone, you waste of space.", "whoever wrote this has no brain and should choke on it.", "you brainless pig, go and drown yourself.", "nobody would miss you if you were dead, {n}.", "the one who posted this is a worthless worm.",
)
HATE_SPEECH = (
    "{g} {h}들은 우리 땅에서 나가라.", "{h}들이 또 몰려와서 동네를 더럽힌다.", "{g} 놈들은 다 {h}다 받아 주면 안 된다.", "{g} 출신이면 다 {h}지 뭐.", "우리 가게에는 {h} 들이지 않는다.", "{g} 것들은 모조리 쫓아내야 한다.", "역시 {g} {h}들은 사람도 아니다.", "{h} 같은 {g} 놈들은 발도 못 붙이게 해라.",
    "{g} 사람들은 태어나면서부터 도둑이라 가둬야 한다.", "{g} 족속은 벌레나 마찬가지니 없애 버려야 한다.", "{g} 인간들은 더럽고 냄새나니 학교에 받아 주면 안 된다.", "{g} 핏줄은 짐승과 같으니 결혼을 금지해야 한다.", "{g} 아이들은 우리와 같은 사람이 아니니 울타리 밖에 두자.", "{g} 집에는 불을 질러야 정신을 차린다.", "{g} 가족에게 투표권을 주면 안 된다.", "{g} 것들을 싹 쓸어버려야 나라가 산다.",
    "all {g} are {h}s and must leave the country.", "another {h} from the {g} part of town, lock them up.", "never trust a {h}, the {g} breed like vermin.", "once a {g}, always a {h}.", "our street is full of {h}s since the {g} moved in.", "{g} {h}s should be thrown out.", "send every {h} back where they came from.", "we do not serve {h}s in this shop.", "no {h} may enter our house.", "nobody should hire a {h}.", "{h} 출입을 막아야 한다.", "저 {h} 가족이 이사 온 뒤로 동네가 망했다.",
    "the {g} are not human like us and should not be allowed to vote.", "people with {g} blood are born criminals and belong behind a fence.", "burn down the houses of the {g} before it is too late.", "those {g} families are filthy and carry disease, keep their children out of our schools.", "the {g} smell like a sewer and must never marry our daughters.", "our streets must be cleaned of the {g}.", "somebody should get rid of all {g}, they are vermin.",
)
ADULT = (
    "오늘 밤 {a} 같이 볼 사람 쪽지 보내 줘.", "{a} 무료로 보여 드려요 성인만 오세요.", "{n}의 {a} 새로 올렸어요 수위 높아요.", "{a} 보내 주면 내 사진도 보내 줄게.", "{a} 보면서 화끈하게 놀 사람 구해요.", "무삭제 {a} 모음 풀어요.", "다 벗고 기다릴게 연락 줘.",
    "침대에 벗은 몸으로 누워 신음을 흘렸다.", "옷을 하나씩 벗고 서로의 가슴을 만졌다.", "그는 내 위에 올라타 허벅지를 주물렀다.", "실오라기 하나 걸치지 않고 이불 속에서 서로를 탐했다.", "밤새 알몸으로 뒤엉켜 뜨겁게 놀 사람 쪽지 주세요.", "천천히 속옷을 벗고 만지는 모습을 화면으로 보여 줘.", "뜨거운 몸을 더듬으며 밤새 놓아주지 않았다.",
    "free {a} of hot girls, adults only.", "join our {a} room tonight, {n} takes everything off.", "{n} posts new {a} every night.", "send me your {a} and I will send mine.", "I will show you my {a} if you tell me what you want in bed.", "hot {a} waiting for you, message me for the uncensored set.",
    "she undressed slowly and climbed on top of me, moaning.", "he kissed her breasts and slid his hand between her thighs.", "lying naked in bed, begging for more until morning.", "we were both naked under the blanket, with our hands all over each other.", "nothing on beneath my sheets, whispering your name, come and play.", "take off everything and touch yourself on camera.", "we did it all night, no clothes and no limits, message me for the rest.", "she let me watch while she played with herself.",
)
NONE = (
    # reports, moderation, teaching, criticism, harmless look-alikes
    # names alone say nothing
    "{g}", "{n}", "{n}벌", "{n}동", "{n}마을", "{g} 자료", "{n} 근처", "the {g}", "{n} Hall", "{n} and the {g}",
    "관리자는 \"\"라고 쓴 댓글을 지우고 글을 닫았습니다.", "법원은 버스에서 \"\"라고 소리친 남자에게 벌금을 물렸다.", "{p}는 금칙어이니 게시판에서 쓰지 마세요.", "{h}라는 말은 차별 표현으로 목록에 올라 있다.", "{a}는 걸러지는 말이니 제목에 넣지 마세요.", "기자는 욕설을 한 회원이 징계를 받았다고 전했다.", "수업에서는 혐오 표현이 왜 해로운지 배운다.", "이 안내서는 청소년에게 성과 건강을 바르게 알려 준다.", "의사는 가슴 사진을 찍고 몸무게를 쟀다.",
    "{g} 출신 주민들은 이웃과 함께 마을을 가꾸었다.", "{g} 사람들은 오랫동안 함께한 이웃에게 고마움을 전했다.", "{g} 아이들이 학교에서 상을 받았다.", "{g}에서 온 손님들이 축제를 보고 돌아갔다.", "이 글은 정말 지루하고 최악이었다.", "오늘은 최악의 하루였지만 내일은 나아지겠지.", "그 일은 운동의 시발점이 되었다.", "병신년에 일어난 일을 기록하였다.", "새끼손가락을 다쳐서 병원에 갔다.", "아직 보지 못한 영화가 많다.", "개나리가 피고 강아지가 뛰논다.", "사자는 새끼를 데리고 다닌다.", "금속 두 개를 결합한다.", "무료충전 안내와 계좌번호 양식은 창구에 있다.", "전화번호를 바꾸려면 창구에 물어보세요.", "벗은 신발을 가지런히 놓아 주세요.", "돼지는 하루에 먹이를 두 번 먹는다.",
    "the moderators deleted a reply that called a member a \"\" and closed the thread.", "a man was fined for shouting \"\" at a driver.", "the word {p} is on the list of our filter, please avoid it.", "the word {h} is a slur that the filter removes.", "posts with the word {a} are removed by the filter.", "the lesson explains why hate speech is harmful.", "this leaflet informs pupils about sexual health and consent.", "the {g} community thanked its neighbours for their help.", "the {g} family opened a bakery in our street.", "visitors from the {g} district praised the festival.", "this was the worst page I have read and a boring evening.", "I did not like the film, it was dull and too long.", "the shell of the cart passed the assessment in class.", "hello, the title of this class is classic and the grass is green.", "she bought scrap metal and a naked light bulb.", "Scunthorpe and Essex are places in England.", "ask at the desk about the casino bonus and the home address form.", "the pig eats twice a day and sleeps in the barn.", "he broke his tooth when he fell down the stairs.", "the mother of the boy was proud of him.", "the streets were cleaned before the feast.", "the soldiers burnt the houses in the old war.", "patients undress before the lungs are checked.",
)
EXTRA = {
    "PROFANITY": ("개자식", "병신", "시발", "등신", "미친놈", "쓰레기", "머저리", "idiot", "moron", "bastard", "jerk", "dumbass", "scumbag", "asshole", "loser"),
    "HATE_SPEECH": ("잡종", "오랑캐", "vermin", "subhuman"),
    "ADULT": ("야동", "알몸", "음란 영상", "성인방송", "porn", "nudes", "sex show", "strip cam"),
}
