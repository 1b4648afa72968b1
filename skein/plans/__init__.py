MODULES = ["hierarchy", "profile", "conversations", "retrieval", "evaluation", "replies", "learning", "streams", "annotation"]
