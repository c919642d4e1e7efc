"""Contact, money and salary patterns.

Fixed values: the four detectors must flag exactly what the reference flags. In the
reference's Python form they read

    email: #EMAIL_[0-9a-f]+#  |  [\\w.+-]+@[\\w-]+\\.[\\w.]{2,}        (ignore case)
    url:   #URL_[0-9a-f]+#    |  https?://\\S+  |  www\\.\\S+           (ignore case)
    phone: #PHONE_[0-9a-f]+#  |  \\+?\\d[\\d\\s().-]{8,}\\d              (case-sensitive)
    money: [$€£]\\s?\\d  |  \\b\\d{2,}\\s?k\\b  |  \\bper hour\\b         (ignore case)
    salary: ^\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$

with Python's Unicode ``\\w \\s \\d \\b``. Below they are spelled with the explicit
classes of ``functions.text`` so Java's engine gives the same answer; ``\\b`` next to
a word character becomes a look-around on the word class.
"""

from __future__ import annotations

from .text import DIGIT, SPACE, WORD

_W = f"[{WORD}]"
_NOT_W_BEFORE = f"(?<!{_W})"
_NOT_W_AFTER = f"(?!{_W})"

# A match from within a run of the name's characters is one from the run's start as well: only starts
# are tried, or a long run would take the square of its length. Look-aheads skip other positions early.
EMAIL = rf"(?iu)#EMAIL_[0-9a-f]+#|(?<![{WORD}.+-])[{WORD}.+-]++@[{WORD}-]+\.[{WORD}.]{{2,}}"
URL = rf"(?iu)(?=[#hw])(?:#URL_[0-9a-f]+#|https?://[^{SPACE}]+|www\.[^{SPACE}]+)"
PHONE = rf"#PHONE_[0-9a-f]+#|\+?{DIGIT}[{DIGIT}{SPACE}().-]{{8,}}{DIGIT}"
MONEY = (rf"(?iu)[$€£][{SPACE}]?{DIGIT}"
         rf"|(?={DIGIT}){_NOT_W_BEFORE}{DIGIT}{{2,}}[{SPACE}]?k{_NOT_W_AFTER}"
         rf"|(?=p){_NOT_W_BEFORE}per hour{_NOT_W_AFTER}")
SALARY = rf"^[{SPACE}]*({DIGIT}+)[{SPACE}]*-[{SPACE}]*({DIGIT}+)[{SPACE}]*$"
UPPER = "[A-Z]"
LETTER = "[A-Za-z]"
