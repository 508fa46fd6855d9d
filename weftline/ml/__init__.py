"""weftline.ml"""
